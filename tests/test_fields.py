"""Fields of sources kept as one row, against the column forms that shuffle cells."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quakeframe.functions.scalars import with_geodesic
from quakeframe.operators import fields as A
from quakeframe.operators import grid as G
from quakeframe.operators import kernels as K
from quakeframe.operators import masks as M
from quakeframe.operators import stack as S
from quakeframe.sources.files import MEASUREMENTS


def map_of(grid):
    c = grid.select("i_lat", "i_lon", "lat", "lon", "x_km", "y_km").orderBy("i_lat", "i_lon").toPandas()
    return c, A.Map(*(c[n].to_numpy() for n in c))


def test_arrays_equal_columns(spark):
    """Gaps in the map, a missing value, all coverage modes and geodesics."""
    grid = G.grid_axes(spark, (-0.6, 0.6, 0.2), (-0.2, 0.8, 0.2)).filter("NOT (i_lat = 2 AND i_lon = 3)").localCheckpoint()
    cells, m = map_of(grid)
    v = np.random.default_rng(3).normal(size=(2, len(m)))
    v[1, 9] = np.nan
    rows = [(5, s, int(i), int(j), float(x), float(y), None if np.isnan(z) else float(z)) for s in (0, 1) for i, j, x, y, z in zip(cells.i_lat, cells.i_lon, cells.x_km, cells.y_km, v[s], strict=True)]
    t = spark.createDataFrame(rows, "period_s int, source int, i_lat int, i_lon int, x_km double, y_km double, value double").localCheckpoint()
    t = G.adjacent_to_null(G.laplacian(G.gradient(t, "lon", out="east")))
    want = t.orderBy("source", "i_lat", "i_lon").toPandas()
    for name, got in (("east", m.east.gradient(v)), ("laplacian", m.laplacian(v)), ("adjacent", m.adjacent(v))):
        assert np.allclose(want[name].to_numpy(float).reshape(2, -1), got.astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), name
    lon, lat = np.array([-0.6, 0.0, 0.6, 0.1]), np.array([0.8, 0.1, -0.2, 0.75])
    r = spark.createDataFrame([(5, 0, float(x), float(y)) for x, y in zip(lon, lat, strict=True)], "period_s int, source int, rcv_lon double, rcv_lat double")
    for mode in ("nearby", "quadrants", "either"):
        c = G.station_coverage(grid, r, m.middle, mode, 25.0, 60.0, 3).orderBy("i_lat", "i_lon").toPandas()
        assert c.covered.tolist() == m.covered(lon, lat, mode, 25.0, 60.0, 3, held=50).tolist()
    g = with_geodesic(grid.withColumns({"a": F.lit(-3.0), "b": F.lit(1.0)}), "a", "b", "lon", "lat").select("g.*", "i_lat", "i_lon").orderBy("i_lat", "i_lon").toPandas()
    d, az = m.geodesics(np.array([-3.0, -3.0]), np.array([1.0, 1.0]))
    assert d[1] == pytest.approx(g.distance_km.to_numpy()) and az[0] == pytest.approx(g.azimuth.to_numpy())
    n = max(0, min(2, (min(m.n_lat, m.n_lon) + 1) // 2))
    assert A.boundary(m, n).tolist() == M.boundary_cells(grid, m.n_lat, m.n_lon, n).orderBy("i_lat", "i_lon").toPandas().boundary.tolist()


def test_no_cell_is_shuffled(spark):
    grid = G.grid_axes(spark, (-0.6, 0.6, 0.2), (-0.2, 0.8, 0.2)).localCheckpoint()
    rows = [("ZZ", "S1", f"R{i}", -1.6, 0.2, -0.6 + 0.2 * i, 0.2 * (i % 3), 10, 3.5, 20.0, True, 1.0, None) for i in range(6)]
    f = K.event_fields(spark.createDataFrame(rows, MEASUREMENTS), grid)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and f.count() == 42


def test_angles_are_repeated_only_near_the_turn(spark):
    e = spark.range(2880).select(F.lit(5).alias("period_s"), F.lit(0).alias("cell"), (F.col("id") / 8).alias("azimuth"))
    e = e.unionByName(e.limit(1).withColumn("azimuth", F.lit(None).cast("double")))
    plan = S.azimuth_peers(e, 20.0).filter("azimuth IS NOT NULL")
    assert {r["peers"] for r in plan.collect()} == {321}
    assert S.turned(e, 20.0).count() == 2880 + 1 + 321


def measured(spark, receivers=9, sources=3):
    rng = np.random.default_rng(6)
    rows = [("ZZ", f"S{s}", f"R{i}", -1.6 + 0.1 * s, 0.2, -0.6 + 0.15 * i, 0.8 * float(rng.random()), p, 3.5 + 0.05 * float(rng.random()), 20.0, True, 1 + 0.01 * float(rng.random()), None) for s in range(sources) for i in range(receivers if s else 2) for p in (10, 20)]
    return spark.createDataFrame(rows, MEASUREMENTS), G.grid_axes(spark, (-0.6, 0.6, 0.2), (-0.2, 0.8, 0.2)).localCheckpoint()


def test_fields_that_are_read_once_are_not_written(spark, monkeypatch):
    """Wanted columns alone, of sources with too few points too."""
    from quakeframe import registry

    d, grid = measured(spark)
    whole = K.event_fields(d, grid).localCheckpoint()

    def fails(_):
        raise AssertionError("written")

    monkeypatch.setattr(K, "cut", fails)
    registry.QUERIES["k5_event_fields"](spark, "/root/testdata/sf0.001")
    for wanted in (("i_lat", "i_lon", "slowness", "reason", "helmholtz_reason"), ("cell", "deflection", "boundary", "helmholtz_slowness", "velocity")):
        some = K.event_fields(d, grid, columns=wanted, written=False)
        assert some.columns == ["period_s", "source", *[c for c in whole.columns if c in wanted], "accepted", "helmholtz_accepted", "n_input", "n_used", "n_amplitude", "n_corrected", "n_rejected"]
        assert some.exceptAll(whole.select(some.columns)).count() == 0 and some.count() == whole.count() == 6 * 42
    with pytest.raises(ValueError, match="unknown columns"):
        K.event_fields(d, grid, columns=("speed",))


def test_paths_to_one_receiver_are_taken_by_distance_and_time():
    who, receiver = np.array([0, 0, 0, 0, 1, 1]), pa.array(["a", "a", "a", None, None, "b"])
    lon, lat = np.array([1.0, 1.0, 1.0, 1.0, 1.0, np.nan]), np.zeros(6)
    src, c = np.array([-3.0, 0.0, 0.0, 0.0, 0.0, 0.0]), np.array([3.0, 2.0, 4.0, 3.0, 3.0, 3.0])
    w, r, _, _, d, t = K.usable_paths(who, receiver, lon, lat, src, np.zeros(6), c)
    assert w.tolist() == [0, 0, 0, 0, 1] and r.to_pylist() == ["a", "a", "a", None, None]
    assert d == pytest.approx([111.3195, 111.3195, 445.278, 111.3195, 111.3195], rel=1e-5) and t[:3] == pytest.approx(d[:3] / [4.0, 2.0, 3.0])


def test_maps_write_only_the_cells_they_stack(spark, monkeypatch):
    d, grid = measured(spark, receivers=14, sources=6)
    config = {"max_laplacian": 1.0, "wavelengths": 0.1, "max_difference_s": 50.0, "min_fraction": 0.05}
    stack = {"min_raw_measurements_per_cell": 1, "require_peer": False}
    whole = K.event_fields(d, grid, **config).localCheckpoint()
    want = S.eikonal_vs_helmholtz(whole, **stack).orderBy("period_s", "cell").collect()
    held = []
    monkeypatch.setattr(K, "cut", lambda x: held.append(x.localCheckpoint()) or held[-1])
    got = K.event_maps(d, grid, stack, **config).orderBy("period_s", "cell").collect()
    assert len(held) == 1 and len(got) == len(want) > 10
    assert held[0].agg(F.sum(F.size("slowness"))).first()[0] == whole.filter("reason = 0 AND (accepted OR helmholtz_accepted)").count() < whole.count()
    for a, b in zip(got, want, strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), nan_ok=True, rel=1e-9)
