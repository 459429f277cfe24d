"""Steps whose memory, shuffles or time grew faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import contracts as V
from quakeframe.operators import kernels as N
from quakeframe.operators import models as M
from quakeframe.session import deal


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cycles_of_many_sources_equal_those_of_each():
    rng = np.random.default_rng(8)
    sizes = np.array([1, 30, 2, 87, 30, 88, 3, 1100])
    x, y = (rng.uniform(0, 300, sizes.sum()).round(0) for _ in range(2))
    d = np.hypot(x + 400, y)
    periods = np.array([5, 10, 15, 10, 5, 20, 10, 10])
    t = d / 3.5 + 10 * rng.integers(-1, 2, len(d)) + rng.normal(0, 2, len(d))
    many = N.unwrap_many(x, y, d, t, sizes, periods, 3.0, 5, 3)
    at = 0
    for n, p in zip(sizes, periods, strict=True):
        own = slice(at, at + n)
        for a, b in zip(many, N.unwrap_times(x[own], y[own], d[own], t[own], float(p), 3.0, 5, 3), strict=True):
            assert np.array_equal(a[own], b, equal_nan=True)
        at += n


@pytest.mark.parametrize("neighbours", [None, 12])
def test_plates_of_many_sets_equal_those_of_each(neighbours):
    rng = np.random.default_rng(9)
    p, v, q = rng.uniform(0, 300, (5, 40, 2)), rng.normal(size=(5, 40)), rng.uniform(-50, 350, (70, 2))
    got = N.thin_plates(p, v, q, (0.0, 1.0), neighbours, chunk=32)
    for s, out in zip((0.0, 1.0), got, strict=True):
        for i in range(5):
            assert out[i] == pytest.approx(N.thin_plate(p[i], v[i], q, s, neighbours), rel=1e-9, abs=1e-9)


def test_shuffles_follow_the_rows(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    deal(spark, 216_000_000)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "864"
    deal(spark, 1000)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == spark.conf.get("spark.sql.shuffle.partitions")
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_models_are_dealt_before_their_samples_are_held(spark):
    from quakeframe.plans.inversion import _weighted

    p = spark.range(4).select(F.col("id").alias("model_id"), F.lit(0).alias("seg"), F.lit(1.0).alias("depth"), F.lit(2.0).alias("vs"))
    basis = M.basis_table(spark, 5, 3, [0.0, 1.0, 2.0])
    for d in (M.profile_checks(p), _weighted(p)[0], M.spline_profile(p.select("model_id", F.lit(0).alias("j"), F.lit(1.0).alias("value")), basis)):
        assert "RepartitionByExpression [model_id" in plan(d)


def test_draws_meet_their_segments_without_a_second_join(spark):
    s = spark.createDataFrame([(7, 0, None, 1.0), (7, 1, "a", 2.0), (7, 2, "b", 3.0), (7, 3, "c", 4.0), (8, 0, "a", 5.0)], "model_id int, seg int, v_top_name string, v_top double")
    d = spark.createDataFrame([(1, 1, 0, 7, "a", 10.0), (1, 1, 0, 7, "b", None), (1, 1, 1, 7, "a", 11.0), (1, 1, 1, 7, "a", 12.0)], "station int, chain int, step int, model_id int, parameter string, value double")
    got = M.resolve_parameters(s, d, by=("model_id",))
    assert sorted((r["step"], r["seg"], r["v_top"]) for r in got.collect()) == [(0, 0, 1.0), (0, 1, 10.0), (0, 2, 3.0), (0, 3, 4.0), (1, 0, 1.0), (1, 1, 11.0), (1, 1, 12.0), (1, 2, 3.0), (1, 3, 4.0)]
    assert plan(got).count("Join") == 1


def test_missing_combinations(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 2), (None, 1), ("c", None)], "k string, p int")
    got = {(r["k"], r["p"]) for r in V.missing_combinations(d, ["k"], ["p"]).collect()}
    assert got == {("a", None), ("b", 1), ("b", None), (None, 2), (None, None), ("c", 1), ("c", 2)}


def test_splines_are_solved_many_at_a_time(spark):
    """Repeated depths, missing values and weights, too few depths and a model without weights; samples are read once, no model is a group of its own."""
    z = [0.0, 1.0, 2.0, 4.0, 5.0]
    basis, b = M.basis_table(spark, 4, 2, z), M.bspline_basis(4, 2, np.array(z) / 5)
    rng = np.random.default_rng(11)
    rows = [(m, d, float(v), float(w)) for m in range(1, 40) for d, v, w in zip(z + z[:3], rng.uniform(2, 4, 8), rng.uniform(0, 2, 8), strict=True)]
    rows += [(40, 1.0, 2.0, 1.0), (40, 2.0, 3.0, 1.0), (41, 1.0, 2.0, None), (42, 3.0, 2.0, 1.0), (1, 1.0, None, 1.0), (1, 2.0, 9.0, None), (2, 4.0, 3.0, 0.0), (None, 1.0, 2.0, 1.0)]
    f = M.fit_spline_coefficients(spark.createDataFrame(rows, "model_id int, depth double, vs double, weight double"), basis, 0.1)
    assert "InPandas" not in plan(f) and plan(f).count("Join") == 1
    got = {}
    for r in f.orderBy("model_id", "j").collect():
        got.setdefault(r["model_id"], []).append((r["value"], r["rms"]))
    assert set(got) == set(range(1, 41))
    second = np.diff(np.eye(4), 2, axis=0)
    for m, found in got.items():
        own = [(z.index(d), v, w) for k, d, v, w in rows if k == m and v is not None]
        use = [(k, v, w) for k, v, w in own if w is not None]
        k, v, w = (np.array(x) for x in zip(*use, strict=True))
        a = (b[k] * w[:, None]).T @ (b[k] * w[:, None]) + 0.1 * second.T @ second
        want = np.linalg.lstsq(a, (b[k] * w[:, None]).T @ (v * w), rcond=None)[0]
        assert [x for x, _ in found] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)
        assert found[0][1] == pytest.approx(float(np.sqrt(np.mean([(v - b[k] @ want) ** 2 for k, v, _ in own]))), abs=1e-9)


def test_small_local_systems_are_eliminated_side_by_side(monkeypatch):
    """Points off a line need no solve of their own; those on a line, or nearly, go to the solver as before."""
    rng = np.random.default_rng(13)
    p, v, q = rng.uniform(0, 300, (7, 40, 2)), rng.normal(size=(7, 40)), rng.uniform(-50, 350, (90, 2))
    solved, own = [], N._smoothed
    monkeypatch.setattr(N, "_smoothed", lambda m, right, w: solved.append(m[..., 0, 0].size) or own(m, right, w))
    got = N.thin_plates(p, v, q, (0.0, 1.0), 12)
    assert not solved
    p[4, :, 1] = p[4, :, 0] + 1e-9 * p[4, :, 1]
    again = N.thin_plates(p, v, q, (0.0, 1.0), 12)
    assert sum(solved) == 2 * 90
    monkeypatch.setattr(N, "SMALL", 0)
    want = N.thin_plates(p, v, q, (0.0, 1.0), 12)
    rest = [0, 1, 2, 3, 5, 6]
    assert got[:, rest] == pytest.approx(want[:, rest], rel=1e-9, abs=1e-9) and np.array_equal(got[:, rest], again[:, rest])
    assert np.array_equal(again[:, 4], want[:, 4], equal_nan=True)


def test_points_get_their_distance_a_batch_at_a_time(spark):
    from quakeframe.functions.scalars import geodesic
    from quakeframe.plans.kernels import _points

    rows = [(True, -10.0, 40.0, -9.95 + 0.7 * i, 40.05 + 0.3 * i, 3.0) for i in range(30)] + [(True, 1.0, 2.0, 1.0, 2.0, 3.0), (True, None, 40.0, 1.0, 1.0, 3.0), (False, 0.0, 0.0, 1.0, 1.0, 3.0)]
    d = _points(spark.createDataFrame(rows, "valid boolean, src_lon double, src_lat double, rcv_lon double, rcv_lat double, c double"))
    assert "atan" not in plan(d).lower()
    found = d.withColumn("want", geodesic(*map(F.col, ("src_lon", "src_lat", "rcv_lon", "rcv_lat")))["distance_km"]).collect()
    assert len(found) == 32 and found[30]["distance_km"] == 0 and found[31]["distance_km"] is None and found[31]["travel_time"] is None
    assert [r["distance_km"] for r in found[:30]] == pytest.approx([r["want"] for r in found[:30]], rel=1e-12)


def test_event_windows_come_record_by_record(spark):
    """Both ends of a window belong to it; runs of one record keep a written result small."""
    from datetime import datetime, timedelta

    from quakeframe.operators import traces as T

    start = datetime(2024, 1, 1)
    catalog = spark.createDataFrame([(i, start + timedelta(minutes=20 * i), 5.0) for i in range(60)], "event_id long, origin timestamp, magnitude double")
    records = spark.createDataFrame([(1000 + i, "c", start + timedelta(minutes=10 * (i * 7 % 150))) for i in range(150)] + [(2000, "c", None)], "record_id long, channel string, t timestamp")
    want = {(i, 1000 + k) for i in range(60) for k in range(150) if 0 <= 10 * (k * 7 % 150) - 20 * i <= 120}
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for limit in ("-1", "10m"):
            for k in before:
                spark.conf.set(k, limit)
            found = T.event_windows(catalog, records)
            assert found.columns == ["event_id", "origin", "magnitude", "record_id", "channel", "t"]
            rows = [(r["event_id"], r["record_id"]) for r in found.collect()]
            assert len(rows) == len(want) and set(rows) == want
            ids = [r for _, r in rows]
            assert 1 + sum(a != b for a, b in zip(ids[:-1], ids[1:], strict=True)) == len(set(ids))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
