"""Groups that are dealt to tasks by ranges, against the windows that hold a group in one task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import curves as K
from quakeframe.operators import ranges as R
from quakeframe.operators import stack as A

HUGE = 1 << 40


def events(spark):
    """90 % of the rows in one cell, many on one azimuth; cells of one row, of none accepted, and of a NULL key."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        cell = 0 if i % 10 else int(1 + i // 10 % 25)
        azimuth = [float(rng.uniform(-180, 540)), 45.0, float(rng.normal(100, 0.01)), float(rng.integers(0, 36) * 10)][i % 4]
        rows.append((5, None if cell == 25 else cell, i, float(rng.normal(0.3, 0.02)), azimuth, int(rng.random() < 0.05), True))
    rows += [(5, 77, 5000, 0.3, 10.0, 0, True), (5, 78, 5001, 0.3, 10.0, 0, False), (5, 0, 5002, 0.9, 45.0, 0, True), (5, 0, 5003, 0.31, None, 0, True), (5, 0, 5004, None, 12.0, 0, True)]
    return spark.createDataFrame(rows, "period_s int, cell int, source int, slowness double, azimuth double, reason int, accepted boolean")


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def equal(got, want):
    a, b = (sorted((tuple(r.asDict()[c] for c in want.columns) for r in d.collect()), key=lambda r: repr(r[:3])) for d in (got, want))
    return len(a) == len(b) and all(near(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("width", [0.0, 20.0, 179.9])
def test_peers_of_a_crowded_cell(spark, width):
    d = events(spark).select("period_s", "cell", "source", "azimuth")
    got, want = A.azimuth_peers(d, width, large=100), A.azimuth_peers(d, width, large=HUGE)
    assert equal(got.drop("azimuth"), want.drop("azimuth"))
    assert got.filter("azimuth IS NULL").first()["peers"] == 0


def test_stack_of_a_crowded_cell(spark):
    d = events(spark)
    for config in ({}, {"iterations": 2, "clip_deviations": 1.5}, {"clip_deviations": None, "require_peer": False}):
        assert equal(A.stack_cells(d, min_raw_measurements_per_cell=3, large=100, **config), A.stack_cells(d, min_raw_measurements_per_cell=3, large=HUGE, **config))
    assert equal(A.peer_weights(d, large=100).select("period_s", "cell", "source", "w"), A.peer_weights(d, large=HUGE).select("period_s", "cell", "source", "w"))
    assert A.stack_cells(d.limit(0), large=100).count() == 0


def test_a_crowded_cell_is_dealt_evenly(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(1, 0, float(x)) for x in np.concatenate([rng.normal(50, 0.001, 9000), rng.uniform(0, 360, 1000)])], "period_s int, cell int, v double")
    sizes = [r["count"] for r in R.in_ranges(d, ("period_s", "cell", "v"), 8).groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]


def test_running_sums_and_gaps(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(g), int(x)) for g, x in zip(rng.integers(0, 3, 500), rng.integers(0, 5000, 500), strict=True)})
    d = spark.createDataFrame([(g, x, x % 7) for g, x in rows], "g int, x int, n int")
    want = {(g, x): sum(y % 7 for h, y in rows if h == g and y <= x) for g, x in rows}
    assert {(r["g"], r["x"]): r["s"] for r in R.running_sum(d, ("g",), ("x",), "n", "s", 7).collect()} == want
    gaps = {r["g"]: (r["lo"], r["hi"], r["gap"]) for r in R.largest_gaps(d, ("g",), "x", 7).collect()}
    for g in range(3):
        own = [x for h, x in rows if h == g]
        assert gaps[g] == (own[0], own[-1], max(b - a for a, b in zip(own, own[1:], strict=False)))


@pytest.mark.parametrize("mode", ["linear", "clamp", "null"])
def test_long_curve_without_keys(spark, mode):
    rng = np.random.default_rng(6)
    x = np.unique(rng.uniform(0, 10, 60))
    nodes = [(float(a), float(np.sin(a))) for a in x] + [(4.2, None), (None, 1.0)]
    asked = [(i, float(q)) for i, q in enumerate(np.concatenate([rng.uniform(-3, 14, 400), x[:5], x[-5:]]))] + [(900, None)]
    curve = spark.createDataFrame(nodes, "period double, velocity double")
    q = spark.createDataFrame(asked, "id int, period double")
    long, short = (K.interpolate_at(curve, q, extrapolate=mode, nodes_at_once=n) for n in (2, 1000))
    got, want = ({r["id"]: r["reference"] for r in d.collect()} for d in (long, short))
    assert got.keys() == want.keys() and all((got[i] is None and want[i] is None) or got[i] == pytest.approx(want[i], abs=1e-9) for i in got)
    assert "Cartesian" not in long._jdf.queryExecution().executedPlan().toString()


def test_sparse_ranges_know_nodes_far_away(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (100.0, 3.0), (101.0, 5.0)], "period double, velocity double")
    q = spark.range(0, 4000).select("id", (F.col("id") / 40 + 0.5).alias("period"))
    got = K.interpolate_at(curve, q, nodes_at_once=1)
    want = lambda x: 2 * x if x <= 1 else 2 + (x - 1) / 99 if x <= 100 else 3 + 2 * (x - 100)
    assert all(r["reference"] == pytest.approx(want(r["period"])) for r in got.collect()) and got.count() == 4000
