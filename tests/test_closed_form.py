"""Closed-form cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.operators import contracts as V
from quakeframe.operators import curves as K
from quakeframe.operators import fits as P
from quakeframe.operators import grid as G
from quakeframe.operators import hk as H
from quakeframe.operators import kernels as N
from quakeframe.operators import masks as M
from quakeframe.operators import models as L
from quakeframe.operators import robust as R
from quakeframe.operators import stack as A
from quakeframe.operators import traces as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_scalars(spark):
    lit = lambda *a: [F.lit(float(x)) for x in a]
    assert one(spark, S.wrap180(F.lit(540.0))) == -180 and one(spark, S.wrap180(F.lit(-190.0))) == 170
    g = one(spark, S.geodesic(*lit(0, 0, 1, 0)))
    assert g["distance_km"] == pytest.approx(111.31949, abs=1e-4) and g["azimuth"] == pytest.approx(90) and g["back_azimuth"] == pytest.approx(-90)
    assert one(spark, S.geodesic(*lit(5, 45, 5, 45)))["distance_km"] == 0
    assert one(spark, S.geodesic(*lit(0, 0, 0, 1)))["distance_km"] == pytest.approx(110.574389, abs=1e-4)
    assert one(spark, S.travel_time(F.lit(10.0), F.lit(0.0))) is None
    assert one(spark, S.helmholtz_correction(F.lit(2.0), F.lit(0.5), F.lit(10.0))) == pytest.approx(0.5 / (2 * (2 * math.pi / 10) ** 2))
    assert one(spark, S.filter_alpha(F.lit(175.0))) == pytest.approx(10.0) and one(spark, S.filter_alpha(F.lit(1e6))) == 75.0
    assert one(spark, S.vp_from_vs(F.lit(4.6))) is None and one(spark, S.snr_db(F.lit(5.0))) == pytest.approx(20 * math.log10(5))
    assert one(spark, S.snr_db(F.lit(-1.0))) == 3.0 and one(spark, S.pi_over_4(F.lit("ZT"))) is None
    p = one(spark, S.parabolic_peak(*lit(1, 3, 2)))
    assert p["offset"] == pytest.approx(1 / 6) and one(spark, S.parabolic_peak(*lit(1, 1, 1)))["offset"] == 0


def field(spark, f, n=8):
    rows = [(1, 0, i, j, float(j), float(i), float(f(j, i))) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "period_s int, source int, i_lat int, i_lon int, x_km double, y_km double, value double")


def test_stencils_on_a_plane_and_a_quadratic(spark):
    d = G.gradient(G.gradient(field(spark, lambda x, y: 0.12 * x + 0.20 * y), "lon", out="east"), "lat", out="north").collect()
    assert all(r["east"] == pytest.approx(0.12) and r["north"] == pytest.approx(0.20) for r in d)
    lap = G.laplacian(field(spark, lambda x, y: x * x + 2 * y * y)).collect()
    assert all(r["laplacian"] == pytest.approx(6) for r in lap)


def test_gradient_needs_neighbours(spark):
    d = field(spark, lambda x, y: x).filter("NOT (i_lon = 3 AND i_lat = 2)")
    got = {(r["i_lat"], r["i_lon"]): r["gradient"] for r in G.gradient(d, "lon").collect()}
    assert got[2, 2] is None and got[2, 4] is None and got[1, 3] == pytest.approx(1)


def test_grid(spark):
    g = G.grid_axes(spark, (-1.0, 1.0, 0.5), (40.0, 41.0, 0.5))
    assert g.count() == 15 and g.filter("i_lon = 0 AND i_lat = 0").first()["y_km"] == 0
    with pytest.raises(ValueError):
        G.inclusive_axis(0, 1, 0.3)


def test_isolated_azimuth_is_dropped(spark):
    rows = [(10, 0, 1, 0.25, 0.0, 0, True), (10, 0, 2, 0.25, 5.0, 0, True), (10, 0, 3, 0.50, 180.0, 0, True)]
    e = spark.createDataFrame(rows, "period_s int, cell int, source int, slowness double, azimuth double, reason int, accepted boolean")
    r = A.stack_cells(e, min_raw_measurements_per_cell=1).first()
    assert r["velocity"] == pytest.approx(4.0) and r["count"] == 2 and r["raw_count"] == 3 and not r["mask"]
    assert A.stack_cells(e, min_raw_measurements_per_cell=4).first()["mask"]


def test_peers_are_circular_and_partition_free(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(-180, 180, 300)
    rows = [(1, int(i % 3), int(i), float(x)) for i, x in enumerate(a)]
    d = spark.createDataFrame(rows, "period_s int, cell int, source int, azimuth double")
    want = {i: sum(1 for j in range(300) if j % 3 == i % 3 and min(abs(a[i] - a[j]), 360 - abs(a[i] - a[j])) <= 20.5) for i in range(300)}
    for n in (1, 7):
        assert {r["source"]: r["peers"] for r in A.azimuth_peers(d.repartition(n), 20.5).collect()} == want


def test_reasons(spark):
    true, false = F.lit(True), F.lit(False)
    assert one(spark, M.first_reason({"boundary": true, "adjacent": true, "unstable": true})) == 4
    assert one(spark, M.first_reason({"unstable": true, "velocity": true})) == 1
    assert one(spark, M.first_reason({"unstable": false}, F.lit(True))) == 8 and one(spark, M.first_reason({"unstable": false})) == 0


def test_contracts_catch_a_planted_violation(spark):
    path = lambda s, r, lon=0.0, c=3.5: ("ZZ", s, r, lon, 1.0, 2.0, 3.0, 10, c, 20.0, True, 1.0, None)
    from quakeframe.sources.files import MEASUREMENTS

    d = spark.createDataFrame([path("A", "B"), path("A", "B"), path("C", "C", 2.0), path("A", "D", 0.1), path("E", "F", 1.0, -1.0)], MEASUREMENTS)
    assert {r["rule"] for r in V.check_unique_paths(d).collect()} == {"self_pair", "repeated_path"}
    assert {r["key"] for r in V.check_station_coordinates(d).collect()} >= {"A"}
    assert [r["rule"] for r in V.check_ranges(d).collect()] == ["c_positive"]
    with pytest.raises(ValueError):
        V.assert_contract(V.check_ranges(d))
    V.assert_contract(V.check_ranges(d.filter("c > 0")))


def test_rotation_at_zero_angles(spark):
    rows = [(1, c, 0, float(k + 1), 0.0, 0.0) for k, c in enumerate(("ZZ", "ZN", "ZE", "NZ", "NN", "NE", "EZ", "EN", "EE"))]
    d = spark.createDataFrame(rows, "pair int, component string, i int, v double, azimuth double, back_azimuth double")
    got = {r["component"]: r["v"] for r in T.rotate_components(d).collect()}
    assert got == pytest.approx({"ZZ": 1, "ZR": 2, "ZT": 3, "RZ": -4, "RR": -5, "RT": -6, "TZ": -7, "TR": -8, "TT": -9})
    assert {r["component"] for r in T.rotate_components(d.filter("component <> 'EE'"), ("ZR", "TT")).collect()} == {"ZR"}


def trace(spark, values, k=0, station=0, b=0.0, dt=1.0):
    return spark.createDataFrame([(k, station, i, b + i * dt, float(x)) for i, x in enumerate(values)], "trace_id long, station long, i int, t double, v double")


def test_snr(spark):
    v = [10.0 if 48 <= i <= 52 else 2.0 for i in range(101)]
    picks = spark.createDataFrame([(0, 2.0, 1.0, 50.0)], "trace_id long, period double, group_velocity double, distance double")
    assert T.window_snr(trace(spark, v), picks, "complement").first()["snr"] == pytest.approx(5.0)
    assert T.window_snr(trace(spark, v), picks, "complement", decibel=True).first()["snr"] == pytest.approx(20 * math.log10(5))
    got = {r["i"]: r["snr"] for r in T.peak_snr(trace(spark, [4, 1, 10, 2, 6])).collect()}
    assert got == pytest.approx({2: 10 / math.sqrt(2)})


def test_f_distribution_of_equal_degrees():
    assert T.f_cdf(1.0, 10, 10) == pytest.approx(0.5) and T.f_cdf(4.0, 1, 1) == pytest.approx(2 / math.pi * math.atan(2.0))
    assert T.f_cdf(2.0, 2, 2) == pytest.approx(2 / 3)


def test_leave_one_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 20))
    d = trace(spark, x[0], 0)
    for k in range(1, 6):
        d = d.union(trace(spark, x[k], k))
    got = {r["trace_id"]: r["p"] for r in T.f_test_select(d).collect()}
    full = ((x - x.mean(axis=0)) ** 2).sum()
    for k in range(6):
        y = np.delete(x, k, axis=0)
        less, f = ((y - y.mean(axis=0)) ** 2).sum(), None
        f = (full / (x.size - 1)) / (less / (y.size - 1))
        assert got[k] == pytest.approx(1 - (T.f_cdf(f, x.size - 1, y.size - 1) - T.f_cdf(1 / f, x.size - 1, y.size - 1)))


def test_cycle_shift(spark):
    rows = []
    for p in (10.0, 15.0, 20.0, 25.0):
        ref = 3.0 + p / 100
        rows.append((1, p, 1 / (1 / ref - p / 100.0), ref, 100.0))
    r = K.select_cycle_shift(spark.createDataFrame(rows, "curve int, period double, velocity double, reference double, distance double")).first()
    assert r["shift"] == 1 and r["status"] == "corrected" and r["rmse_after"] == pytest.approx(0, abs=1e-9)


def test_unwrap_phase_recovers_a_constant_velocity(spark):
    d, u = 300.0, 3.5
    rows = [(1, p, u, float(np.angle(np.exp(1j * (2 * math.pi / p) * (d / u - d / 3.5)))) + 2 * math.pi, d) for p in (5.0, 8.0, 12.0, 20.0)]
    ref = spark.createDataFrame([(1.0, 3.5), (50.0, 3.5)], "period double, velocity double")
    got = K.unwrap_phase(spark.createDataFrame(rows, "curve long, period double, group_velocity double, phase double, distance double"), ref).collect()
    assert all(r["phase_velocity"] == pytest.approx(3.5) for r in got) and len(got) == 4


def test_short_branch(spark):
    rows = [(1, 5.0, 5.1, 3.0, 1.0, 10), (1, 6.0, 6.0, 3.1, 2.0, 10)]
    r = K.branch_qc(spark.createDataFrame(rows, "curve int, target_period double, instant_period double, velocity double, amplitude double, initial_count int")).first()
    assert r["retained_fraction"] == pytest.approx(0.2) and r["warn_short"]


def test_p_amplitude_selector(spark):
    rows = [(0, [0] * 5 + [1] + [0] * 5), (1, [0] * 9 + [1, 0]), (2, [0] * 5 + [-1] + [0] * 5)]
    d = trace(spark, rows[0][1], 0, b=-5.0)
    for k, v in rows[1:]:
        d = d.union(trace(spark, v, k, b=-5.0))
    got = {r["trace_id"]: (r["time"], r["value"], r["kept"]) for r in T.p_amplitude_select(d).collect()}
    assert got[0] == (0.0, 1.0, True) and not got[1][2] and not got[2][2]


def test_slowness_reverse(spark):
    d = spark.createDataFrame([(i, s) for i, s in enumerate((0.03, 0.04, 0.1, 0.12))], "trace_id int, slowness double")
    assert [r["slowness"] for r in M.slowness_select(d, 0.04, 0.1, True).collect()] == [0.03, 0.12]


def test_selection_edges(spark):
    d = spark.createDataFrame([(1, 1, 30.0, 1.7, 1.0), (2, 2, 30.0, 1.7, 0.0), (3, 2, 30.0, 1.7, 0.0)], "rf_id int, station int, h double, k double, energy double")
    assert all(r["kept"] for r in R.mahalanobis_select(d).collect())
    assert R.mahalanobis_select(d.limit(0)).count() == 0 and R.robust_summary(d.limit(0)).count() == 0


def test_fit_and_posterior(spark):
    obs = spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0), (1, "a", 2.0, 2.0, 1.0)], "station int, observable string, period double, value double, sigma double")
    pred = spark.createDataFrame([(1, "a", 7, 1.0, 2.0), (1, "a", 7, 2.0, 3.0), (1, "a", 8, 1.0, 2.0)], "station int, observable string, model_id int, period double, predicted double")
    f = {r["model_id"]: r for r in P.gaussian_fit(P.residual_join(obs, pred), 2.0).collect()}
    assert (f[7]["chi2"], f[7]["misfit"], f[7]["weighted_chi2"], f[7]["log_likelihood"]) == (2.0, 1.0, 4.0, -2.0) and f[8]["chi2"] is None
    j = {r["model_id"]: r for r in P.joint_fit(P.gaussian_fit(P.residual_join(obs, pred)), pred).collect()}
    assert j[7]["valid"] and j[8]["log_likelihood"] == float("-inf")


def test_ensemble(spark):
    d = spark.createDataFrame([(1, c, s, lp, a) for c, s, lp, a in ((0, 0, -3.0, 1.0), (0, 1, -2.0, 1.2), (1, 0, -1.0, 1.4), (1, 1, -1.0, 0.8))], "station int, chain int, step int, log_prob double, vs double")
    assert P.ensemble_summary(d, ("station",), "vs").first()["mean"] == pytest.approx(1.1)
    assert P.best_draw(d).first()["vs"] == 1.4


def test_curvature_prior_is_zero_for_lines_and_steps(spark):
    rows = [(1, s, float(z), float(2.0 + s + 0.1 * z)) for s in (0, 1) for z in np.linspace(s, s + 1, 6)]
    r = L.curvature_prior(spark.createDataFrame(rows, "model_id int, seg int, depth double, vs double"), 0.1).first()
    assert r["rms"] == pytest.approx(0, abs=1e-9)


def test_registered_soft_prior(spark, monkeypatch):
    def mean_speed(profile, centre):
        return profile.groupBy("model_id").agg(F.avg("vs").alias("mean")).select("model_id", (-F.abs(F.col("mean") - centre)).alias("log_prior"), "mean")

    rows = [(1, 0, float(z), float(2.0 + 0.1 * z)) for z in range(6)] + [(2, 0, float(z), None) for z in range(6)]
    d = spark.createDataFrame(rows, "model_id int, seg int, depth double, vs double")
    with pytest.raises(ValueError, match="mean_speed"):
        L.soft_priors(d, {"mean_speed": {"centre": 2.0}})
    monkeypatch.setitem(L.SOFT_PRIORS, "mean_speed", mean_speed)
    got = {r["model_id"]: r for r in L.soft_priors(d, {"curvature": {"sigma": 0.1}, "mean_speed": {"centre": 2.0}}).collect()}
    assert got[1]["log_prior"] == pytest.approx(-0.25) and got[1]["mean_speed_mean"] == pytest.approx(2.25) and got[1]["log_curvature"] == pytest.approx(0.0)
    assert got[2]["log_prior"] == float("-inf")
    assert {r["log_prior"] for r in L.soft_priors(d, {}).collect()} == {0.0}
    monkeypatch.setitem(L.SOFT_PRIORS, "mean_speed", lambda profile: profile.select("model_id").distinct())
    with pytest.raises(ValueError, match="log_prior"):
        L.soft_priors(d, {"mean_speed": {}})


def test_spline_basis():
    b = L.bspline_basis(7, 3, np.linspace(0, 1, 50), 1.3)
    assert np.allclose(b.sum(axis=1), 1) and b.min() >= 0 and b[0, 0] == 1 and b[-1, -1] == pytest.approx(1)


def test_spline_fit_recovers_coefficients(spark):
    z = [float(x) for x in np.linspace(0, 10, 40)]
    basis = L.basis_table(spark, 6, 3, z)
    c = spark.createDataFrame([(1, j, float(x)) for j, x in enumerate((1, 3, 2, 4, 3, 5))], "model_id long, j int, value double")
    fitted = L.fit_spline_coefficients(L.spline_profile(c, basis).withColumn("weight", F.lit(1.0)), basis)
    assert [r["value"] for r in fitted.orderBy("j").collect()] == pytest.approx([1, 3, 2, 4, 3, 5])


def test_weighted_spline_fit_equals_least_squares_on_multiplied_rows(spark):
    rng = np.random.default_rng(3)
    z = np.linspace(0, 10, 25)
    vs, w = rng.uniform(2, 4, 25), rng.uniform(0, 3, 25)
    basis = L.basis_table(spark, 6, 3, z.tolist(), 1.4)
    b = L.bspline_basis(6, 3, z / 10, 1.4)
    d = spark.createDataFrame([(1, *map(float, r)) for r in zip(z, vs, w, strict=True)] + [(2, float(x), 3.0, 1.0) for x in z] + [(2, 5.0, None, 1.0)], "model_id int, depth double, vs double, weight double")
    for smooth in (0.0, 0.5):
        second = np.sqrt(smooth) * np.diff(np.eye(6), 2, axis=0)
        want = np.linalg.lstsq(np.vstack([b * w[:, None], second]), np.r_[vs * w, np.zeros(4)], rcond=None)[0]
        rows = L.fit_spline_coefficients(d, basis, smooth).orderBy("model_id", "j").collect()
        assert [r["value"] for r in rows[:6]] == pytest.approx(want.tolist(), rel=1e-6)
        assert rows[0]["rms"] == pytest.approx(float(np.sqrt(np.mean((vs - b @ want) ** 2))))
        assert [r["value"] for r in rows[6:]] == pytest.approx([3.0] * 6) and rows[6]["rms"] == pytest.approx(0, abs=1e-9)


def test_tolerance_join_at_rounding_borders(spark):
    obs = spark.createDataFrame([("A", "love", p, 1.0 + k, 0.1) for k, p in enumerate((1.0000005, 2.0, 3.0, 3.0, 5.0))], "station string, observable string, period double, value double, sigma double")
    pred = spark.createDataFrame([("A", "love", 1, p, 10.0 + k) for k, p in enumerate((1.0000004999, 2.0 + 5e-9, 2.0 - 9e-9, 3.0, 3.0, 5.0001))], "station string, observable string, model_id long, period double, predicted double")
    rows = sorted(P.residual_join(obs, pred).collect(), key=lambda r: (r["period"], r["value"] is None, r["value"] or 0))
    assert [(r["value"], r["predicted"], r["unmatched"]) for r in rows if r["value"] is not None] == [(1.0, 10.0, False), (2.0, 11.0, False), (3.0, 13.0, False), (4.0, 14.0, False), (5.0, None, True)]
    assert sorted(r["predicted"] for r in rows if r["value"] is None) == [12.0, 15.0]


def test_exact_quantiles_by_counting(spark):
    """Skewed and repeated values, NULLs, wide ranges, a null key and groups of one value; few bins, so several passes."""
    rng = np.random.default_rng(8)
    groups = {"a": rng.lognormal(0, 3, 400), "b": np.repeat([1.0, 2.0, 7.0], [200, 3, 1]), None: rng.normal(0, 1, 77), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, 5e-324]), "close": 1 + np.arange(50) * 2.0**-52}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None)]
    d = spark.createDataFrame(rows, "g string, x double").repartition(3)
    qs = (0.0, 0.05, 0.5, 0.84, 1.0)
    got = {r["g"]: [r[f"q{round(100 * q):02d}"] for q in qs] for r in P.exact_quantiles(d, ("g",), "x", qs, bins=8).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        if k != "wide":
            assert got[k] == pytest.approx(np.quantile(v, qs).tolist(), rel=1e-12)
    assert got["wide"][2] == 5e-324 and got["wide"][0] == -1.7e308 and got["wide"][4] == 1.7e308
    plain = {r["g"]: tuple(r)[1:] for r in P.ensemble_summary(d, ("g",), "x").collect()}
    split = {r["g"]: tuple(r)[1:] for r in P.ensemble_summary(d, ("g",), "x", buffered=60).collect()}
    assert set(plain) == set(split) == {*groups, "none"}
    for k in ("a", "b", None, "one", "two", "close"):
        assert split[k] == pytest.approx(plain[k], rel=1e-9)


def test_nearest_points_in_cells_equal_the_full_sort():
    import time

    rng = np.random.default_rng(5)
    for p in (rng.uniform(0, 1, (300, 2)), np.stack(np.meshgrid(np.arange(12.0), np.arange(9.0)), -1).reshape(-1, 2), np.column_stack([np.zeros(40), np.arange(40.0)]), np.repeat(rng.uniform(0, 1, (5, 2)), 20, axis=0), np.ones((7, 2))):
        b = N.Buckets(p)
        for q in np.concatenate([p[::7], rng.uniform(-2, 3, (30, 2)), rng.uniform(-50, 50, (5, 2))]):
            for k in (1, 5, len(p)):
                assert b.nearest(q, k).tolist() == np.argsort(((q - p) ** 2).sum(axis=-1), kind="stable")[:k].tolist()
    p, q = rng.uniform(0, 1, (20_000, 2)), rng.uniform(0, 1, (2_000, 2))
    began = time.process_time()
    N.thin_plate(p, p[:, 0], q, neighbours=12)
    assert time.process_time() - began < 10


def test_cycles_by_cells_equal_those_by_all_distances():
    import time

    rng = np.random.default_rng(6)
    for n in (2, 30, 300):
        x, y = rng.uniform(0, 300, n).round(0), rng.uniform(0, 300, n).round(0)
        d = np.hypot(x + 400, y)
        t = d / 3.5 + 10 * rng.integers(-1, 2, n) + rng.normal(0, 2, n)
        one, two = (N.unwrap_times(x, y, d, t, 10.0, 3.0, 5, 3, matrix=m) for m in (1024, 1))
        for a, b in zip(one, two, strict=True):
            assert np.array_equal(a, b, equal_nan=True)
    seconds = []
    for n in (2000, 8000):
        x, y = rng.uniform(0, 300, n), rng.uniform(0, 300, n)
        d = np.hypot(x + 400, y)
        began = time.process_time()
        fixed, ok, cycles, _ = N.unwrap_times(x, y, d, d / 3.5 + 10 * rng.integers(-1, 2, n), 10.0, 3.0, 1, 1)
        seconds.append(time.process_time() - began)
        assert ok.all() and np.ptp(fixed - d / 3.5) < 1
    assert seconds[1] < 9 * seconds[0], seconds  # sixteen times for squares


def test_late_by_one_period():
    x, y = np.array([0.0, 10, 20, 30]), np.zeros(4)
    d = np.array([100.0, 110, 120, 130])
    t = d / 3.5
    t[3] += 10
    fixed, ok, cycles, _ = N.unwrap_times(x, y, d, t, 10.0, 3.0, 3, 1)
    assert ok.all() and cycles.tolist() == [0, 0, 0, -1] and fixed == pytest.approx(d / 3.5)


def test_thin_plate_passes_through_points_and_keeps_planes():
    rng = np.random.default_rng(0)
    p, q = rng.uniform(0, 100, (12, 2)), rng.uniform(0, 100, (30, 2))
    assert N.thin_plate(p, rng.normal(size=12), p)[0] is not None
    v = rng.normal(size=12)
    assert N.thin_plate(p, v, p) == pytest.approx(v, abs=1e-6)
    assert N.thin_plate(p, 1 + 2 * p[:, 0] - p[:, 1], q) == pytest.approx(1 + 2 * q[:, 0] - q[:, 1], abs=1e-6)


def test_narrow_band_peak_is_at_the_packet(spark):
    t = np.arange(0, 200, 0.5)
    v = np.exp(-(((t - 60) / 12) ** 2)) * np.cos(2 * np.pi * (t - 60) / 5)
    bank = N.ftan(trace(spark, v, dt=0.5), (5.0,), 20.0)
    r = T.pick_peaks(bank, spark.createDataFrame([(0, 180.0)], "trace_id long, distance double"), (2.0, 5.0)).first()
    assert r["group_velocity"] == pytest.approx(3.0, rel=0.02) and r["instant_period"] == pytest.approx(5.0, rel=0.05)


def test_phase_matched_filter_keeps_the_packet():
    t = np.arange(0, 400, 0.5)
    v = np.exp(-(((t - 100) / 15) ** 2)) * np.cos(2 * np.pi * (t - 100) / 5)
    out = N.phase_matched(v + 0.2 * np.sin(t), 0.5, 300.0, np.array([4.0, 5.0, 6.5]), np.array([3.0, 3.0, 3.0]))
    assert abs(t[np.argmax(np.abs(out))] - 100) <= 5 and np.abs(out[t > 250]).max() < 0.05


def test_repaired_jump(spark):
    rows = []
    for i, p in enumerate(np.geomspace(5, 50, 12)):
        rows.append((1, float(p), [(3.0 + 0.01 * i, 1.0 + i), (3.0 + 0.01 * i + 0.5, 50.0 + i)] if i == 6 else [(3.0 + 0.01 * i, 1.0 + i)], int(i == 6)))
    d = spark.createDataFrame(rows, "curve long, period double, candidates array<struct<velocity: double, amplitude: double>>, best int")
    got = N.repair_jumps(d, 0.5, 3, "curve", "velocity").orderBy("period").collect()
    assert [r["velocity"] for r in got] == pytest.approx([3.0 + 0.01 * i for i in range(12)])
    assert [r["amplitude"] for r in got] == pytest.approx([1.0 + i for i in range(12)])
    assert [r["replaced"] for r in got] == [i == 6 for i in range(12)] and {r["initial_count"] for r in got} == {12}
    # Without another candidate the jump stays and the branch ends at it.
    alone = d.withColumn("candidates", F.when(F.size("candidates") > 1, F.slice("candidates", 2, 1)).otherwise(F.col("candidates"))).withColumn("best", F.lit(0))
    left = N.repair_jumps(alone, 0.5, 3, "curve", "velocity").orderBy("period").collect()
    assert len(left) < 12 and not any(r["replaced"] for r in left)


def test_constant_medium_maps_to_its_velocity(spark):
    """From measurements to both maps: acceptance, codes and counts of the fields go straight into the stack."""
    from quakeframe.operators.masks import helmholtz_reason
    from quakeframe.sources.files import MEASUREMENTS

    g = G.grid_axes(spark, (-0.6, 0.6, 0.2), (-0.2, 0.8, 0.2))
    stations = [(f"R{i}", x, y) for i, (x, y) in enumerate([(-0.6, -0.2), (0.0, -0.2), (0.6, -0.2), (-0.6, 0.3), (0.6, 0.3), (-0.6, 0.8), (0.0, 0.8), (0.6, 0.8), (0.2, 0.2)])]
    rows = [("ZZ", s, r, lon, 0.2, x, y, 10, 3.5, 20.0, True, 1.0, None) for s, lon in (("S1", -1.6), ("S2", 1.8)) for r, x, y in stations]
    rows += [("ZZ", "S3", r, 0.0, 3.0, x, y, 10, 3.5, 20.0, True, 1.0, None) for r, x, y in stations[:2]] + [("ZZ", "S1", "R9", -1.6, 0.2, 0.4, 0.4, 10, 3.5, 20.0, False, 1.0, None)]
    f = N.event_fields(spark.createDataFrame(rows, MEASUREMENTS), g, velocity=(2.5, 4.5), wavelengths=0.5, max_laplacian=0.1, min_fraction=0.05).cache()
    by = {r["source"]: r for r in A.field_summary(f).collect()}
    assert [by[s]["accepted"] for s in ("S1", "S2", "S3")] == [True, True, False] == [by[s]["helmholtz_accepted"] for s in ("S1", "S2", "S3")]
    assert [by["S1"][c] for c in ("n_input", "n_used", "n_amplitude", "n_corrected", "n_rejected")] == [9, 9, 9, 0, 0]
    assert by["S3"]["reason_8"] == 42 and f.filter("source = 'S3' AND helmholtz_reason <> 1").count() == 0
    stack = A.eikonal_vs_helmholtz(f, min_raw_measurements_per_cell=1, require_peer=False).agg(F.median("velocity").alias("v"), F.median("helmholtz_velocity").alias("h"), F.count("velocity").alias("n")).first()
    assert stack["n"] > 10 and stack["v"] == pytest.approx(3.5, abs=0.1) and stack["h"] == pytest.approx(3.5, abs=0.1)
    f.unpersist()
    lit = lambda x: F.lit(x).cast("double")
    code = lambda a, c, s, **k: one(spark, helmholtz_reason(F.lit(0), lit(a), lit(c), lit(s), 3.0, computed=F.lit(True), **k))
    assert [code(1, None, 0.3), code(1, 0.2, 0.3), code(1, 0.1, 0.3), code(None, 0, 0.3), code(0.5, 0, 0.3, min_amplitude=0.5), code(1, 0, 0.3, adjacent=F.lit(True)), code(1, 0, 0.3, unstable=F.lit(True)), code(1, 0, 0.3)] == [5, 5, 6, 4, 4, 4, 3, 0]


def test_search_axis():
    assert H.search_axis(1.5, 3.0, 0.4) == pytest.approx([1.5, 2.0, 2.5, 3.0]) and H.search_axis(1.0, 1.0, 0.1) == [1.0]
    with pytest.raises(ValueError):
        H.search_axis(0, 1, 0)


def test_surfaces_in_their_rows_equal_rows_of_cells(spark):
    cell = lambda h, k, a: (h, k, float(h), 1.5 + k, a)
    rows = [(1, 7, [cell(0, 0, 0.5), cell(1, 0, 2.0), cell(0, 1, 2.0)]), (2, 7, [cell(0, 0, 0.0), cell(1, 0, None), cell(0, 1, -1.0)]), (3, 8, [cell(0, 0, None), cell(1, 0, None), cell(0, 1, None)]), (4, 9, [])]
    surfaces = spark.createDataFrame(rows, "trace_id int, station int, surface array<struct<h_idx:int,k_idx:int,h:double,k:double,amp:double>>")
    cells = surfaces.select("trace_id", "station", F.inline("surface"))
    same = lambda a, b: sorted(a.collect(), key=repr) == sorted(b.select(*a.columns).collect(), key=repr)
    assert same(H.best_of(surfaces), H.best_cells(cells)) and H.best_of(surfaces).count() == 2
    assert same(H.mean_surface(surfaces), H.mean_hk_surface(cells))
    assert H.mean_surface(surfaces)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_smoothing_keeps_a_constant(spark):
    d = spark.createDataFrame([(0, i, j, 2.0) for i in range(5) for j in range(4)], "trace_id int, h_idx int, k_idx int, amp double")
    assert all(r["smooth"] == pytest.approx(2.0) for r in H.smooth_surface(d, 5, 4).collect())


def test_pulse_window_is_even_and_quiet():
    """The wider half and the wider skirt hold for both sides; a loud minimum is neither inner nor outer."""
    env = np.full(201, 0.5)
    env[100] = 1.0
    for at, v in ((80, 0.05), (60, 0.1), (50, 0.45), (130, 0.05), (170, 0.1)):
        env[at] = v
    w = N.pulse_window(env, 1.0, 5.0, 0.2, 1.0)
    at = np.arange(201)
    inner, skirt = 30, 40
    want = np.ones(201)
    left, right = at < 100 - inner, at >= 100 + inner
    want[left] = np.exp(-0.5 * ((100 - inner - 1 - at[left]) / (skirt + 1)) ** 2)
    want[right] = np.exp(-0.5 * ((at[right] - 100 - inner) / (skirt + 1)) ** 2)
    assert w == pytest.approx(want)
    one_sided = env.copy()
    one_sided[101:] = 0.6
    assert (N.pulse_window(one_sided, 1.0, 5.0, 0.2, 1.0)[101:] == 1).all()


def test_local_plates_equal_the_whole_one():
    rng = np.random.default_rng(1)
    p, q, v = rng.uniform(0, 100, (15, 2)), rng.uniform(0, 100, (700, 2)), rng.normal(size=15)
    whole = N.thin_plate(p, v, q, 0.5)
    assert N.thin_plate(p, v, q, 0.5, neighbours=15) == pytest.approx(whole, rel=1e-6, abs=1e-6)
    assert N.thin_plate(p, 1 + 2 * p[:, 0] - p[:, 1], q, neighbours=5) == pytest.approx(1 + 2 * q[:, 0] - q[:, 1], abs=1e-6)


def test_tiles_give_the_same_map(spark):
    g = G.grid_axes(spark, (-1.0, 1.0, 0.5), (0.0, 1.0, 0.5))
    rng = np.random.default_rng(2)
    rows = [(10, "S", -1.2, 0.1, float(x), float(y), float(x + 2 * y + 3)) for x, y in zip(rng.uniform(-1, 1, 20), rng.uniform(0, 1, 20), strict=True)]
    d = spark.createDataFrame(rows, "period_s int, source string, src_lon double, src_lat double, rcv_lon double, rcv_lat double, travel_time double")
    one, two = ({(r["i_lat"], r["i_lon"]): r["value"] for r in N.grid_travel_times(d, g, neighbours=6, tiles=t).collect()} for t in (1, 3))
    assert len(one) == 15 and one == pytest.approx(two)


def test_registered_kernel(spark, monkeypatch):
    def plane(points, values, query, smoothing, neighbours):
        ones = lambda p: np.column_stack([np.ones(len(p)), p])
        return ones(query) @ np.linalg.lstsq(ones(points), values, rcond=None)[0] + smoothing

    g = G.grid_axes(spark, (-1.0, 1.0, 0.5), (0.0, 1.0, 0.5))
    rng = np.random.default_rng(7)
    rows = [(10, "S", -1.2, 0.1, float(x), float(y), float(3 * (x + 1.2) + 2 * (y - 0.1))) for x, y in zip(rng.uniform(-1, 1, 20), rng.uniform(0, 1, 20), strict=True)]
    d = spark.createDataFrame(rows, "period_s int, source string, src_lon double, src_lat double, rcv_lon double, rcv_lat double, travel_time double")
    with pytest.raises(ValueError, match="plane"):
        N.grid_travel_times(d, g, kernel="plane")
    monkeypatch.setitem(N.KERNELS, "plane", plane)
    got = N.grid_travel_times(d, g, kernel="plane").join(g, ["i_lat", "i_lon"]).collect()
    assert len(got) == 15
    for r in got:
        assert r["value"] == pytest.approx(3 * (r["lon"] + 1.2) + 2 * (r["lat"] - 0.1), abs=1e-6) and r["other"] == pytest.approx(r["value"] + 1.0)


def test_f_distribution():
    """P(F <= 1) is one half for equal degrees; with two and two degrees P(F <= f) = f / (1 + f)."""
    f = np.array([0.0, 0.2, 1.0, 3.0])
    two = np.full(4, 2.0)
    assert T.f_cdf(f, two, two) == pytest.approx(f / (1 + f), abs=1e-12)
    assert T.f_cdf(np.ones(3), np.array([3.0, 50, 4000]), np.array([3.0, 50, 4000])) == pytest.approx([0.5] * 3, abs=1e-9)


def test_gaps_are_filled_across_blocks(spark):
    d = spark.createDataFrame([("a", 1, 0, i, float(i)) for i in (3, 4, 19)], "channel string, segment int, start long, i long, v double")
    got = sorted((r["i"], r["v"]) for r in T.merge_segments(d, 8).collect())
    assert got == [(i, float(i) if i in (3, 4, 19) else 0.0) for i in range(3, 20)]


def test_plateau_of_a_rising_shoulder_is_no_peak(spark):
    e = [0.0, 1.0, 1.0, 2.0, 3.0, 3.0, 1.0, 0.0]
    d = spark.createDataFrame([(0, 4.0, i, float(i), v, 0.1 * i) for i, v in enumerate(e)], "trace_id long, period double, i int, t double, envelope double, phase double")
    assert T.pick_peaks(d, spark.createDataFrame([(0, 20.0)], "trace_id long, distance double")).first()["i"] == 4


def test_staged_geodesic_equals_the_expression(spark):
    from pyspark.sql import functions as F

    from quakeframe.functions.scalars import geodesic, with_geodesic

    d = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (-10.0, 40.0, 9.5, 48.25), (170.0, -5.0, -170.0, 5.0), (12.0, 89.0, -60.0, -33.0)], "a double, b double, c double, d double")
    both = with_geodesic(d, "a", "b", "c", "d", "s").withColumn("e", geodesic(*map(F.col, "abcd"))).collect()
    assert all(tuple(r["s"]) == pytest.approx(tuple(r["e"])) for r in both)
