"""Model, fit and draw operators on the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import fits as P
from ..operators import models as M
from .base import Catalog, r6

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES


def _rounded(df, n=6):
    return df.select(*[(F.round(c, n) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in df.dtypes])


_DEPTHS = "(SELECT model_id, d AS depth FROM (SELECT DISTINCT model_id FROM segments) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.5, 1, 2, 3, 5, 10, 15, 16]) AS d))"


def _depths(s):
    return s.select("model_id").distinct().withColumn("depth", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 15.0, 16.0)))))


_VALUE = "CASE WHEN profile = 'constant' THEN v_top ELSE v_top + (v_bottom - v_top) * ({d} - top) / (bottom - top) END"
C.add("j13_profile_at_depths", "segments", lambda s: _rounded(M.profile_at_depths(s, _depths(s)), 9), f"SELECT d.model_id, depth, round({_VALUE.format(d='depth')}, 9) AS vs FROM {_DEPTHS} d LEFT JOIN segments s ON s.model_id = d.model_id AND depth >= top AND (depth < bottom OR depth = 15 AND bottom = 15)")
C.add("j15_layer_at_depths", "layers segments", lambda x, s: _rounded(M.layer_at_depths(x, _depths(s))), f"SELECT d.model_id, depth, round(vs, 6) AS vs FROM {_DEPTHS} d JOIN layers l ON l.model_id = d.model_id AND l.layer = CASE WHEN depth < 1 THEN 0 WHEN depth < 3 THEN 1 WHEN depth < 7 THEN 2 ELSE 3 END")


def _j16(s, d):
    one = s.filter("model_id = 0").withColumn("v_top_name", F.when(F.col("seg") > 0, F.concat(F.lit("vs"), F.col("seg"))))
    return _rounded(M.resolve_parameters(one, d).select("station", "chain", "step", "seg", "v_top"))


C.add("j16_resolve_parameters", "segments long_draws", _j16, "SELECT station, chain, step, seg, round(CASE WHEN seg = 0 THEN v_top ELSE value END, 6) AS v_top FROM (SELECT DISTINCT station, chain, step FROM long_draws) k CROSS JOIN (SELECT * FROM segments WHERE model_id = 0) s LEFT JOIN long_draws l USING (station, chain, step) WHERE l.parameter = 'vs' || greatest(seg, 1)")


def _j16_models(s, d):
    """Each station's draws go into the model of its number; all models are read."""
    named = s.withColumn("v_top_name", F.when(F.col("seg") > 0, F.concat(F.lit("vs"), F.col("seg"))))
    return _rounded(M.resolve_parameters(named, d.withColumn("model_id", F.col("station")), by=("model_id",)).select("station", "chain", "step", "seg", "v_top"))


C.add("j16_resolve_by_model", "segments long_draws", _j16_models, "SELECT station, chain, step, seg, round(CASE WHEN seg = 0 THEN v_top ELSE value END, 6) AS v_top FROM (SELECT DISTINCT station, chain, step FROM long_draws) k JOIN segments s ON s.model_id = k.station LEFT JOIN long_draws l USING (station, chain, step) WHERE l.parameter = 'vs' || greatest(seg, 1)")
C.add("w22_depth_axis", "segments", lambda s: _rounded(M.depth_axes(s.groupBy("model_id").agg((F.max("bottom") + F.max("v_bottom")).alias("zmax")), 0.4)), "SELECT model_id, round(unnest(range(CAST(floor((zmax + 0.2) / 0.4::DOUBLE) AS BIGINT) + 1)) * 0.4::DOUBLE, 6) AS depth FROM (SELECT model_id, max(bottom) + max(v_bottom) AS zmax FROM segments GROUP BY model_id)")
C.add(
    "w12_profile_checks",
    "profile",
    lambda p: M.profile_checks(p, 0.0, 0.8, (2.0, 4.0)),
    "WITH p AS (SELECT model_id, depth, arg_max(vs, seg) AS vs FROM profile GROUP BY model_id, depth), d AS (SELECT *, vs - lag(vs) OVER w AS dv, depth - lag(depth) OVER w AS dz FROM p WINDOW w AS (PARTITION BY model_id ORDER BY depth)) SELECT model_id, coalesce(bool_and(dv >= 0), true) AS monotonic, coalesce(bool_and(abs(dv / dz) <= 0.8), true) AS gradient, bool_and(vs BETWEEN 2 AND 4) AS in_range FROM d GROUP BY model_id",
)
C.add("w12_boundary_check", "segments", lambda s: M.boundary_check(s, 0.2), "SELECT model_id, bool_and(coalesce(CASE WHEN pp = 'constant' THEN pt ELSE pb END - v_top <= 0.2, true)) AS boundary FROM (SELECT *, lag(profile) OVER w AS pp, lag(v_top) OVER w AS pt, lag(v_bottom) OVER w AS pb FROM segments WINDOW w AS (PARTITION BY model_id ORDER BY seg)) GROUP BY model_id")


def _w13(x):
    d = M.evaluate_constraints(x.withColumn("vp", F.col("vp") - F.col("model_id") % 3 * 0.8), M.physical_rules(0.533, (1.45, 2.5)))
    return d.select("model_id", F.concat_ws(",", "failed").alias("failed"), "valid")


C.add("w13_evaluate_constraints", "layers", _w13, "SELECT model_id, concat_ws(',', CASE WHEN bool_or(NOT (vs > 0 AND p > 0 AND rho > 0)) THEN 'positive' END, CASE WHEN bool_or(NOT p - vs > 0.533) THEN 'vp_margin' END, CASE WHEN bool_or(NOT p / vs BETWEEN 1.45 AND 2.5) THEN 'vp_vs' END) AS failed, NOT bool_or(NOT (vs > 0 AND p > 0 AND rho > 0) OR NOT p - vs > 0.533 OR NOT p / vs BETWEEN 1.45 AND 2.5) AS valid FROM (SELECT *, vp - model_id % 3 * 0.8::DOUBLE AS p FROM layers) GROUP BY model_id")


def _squared(p):
    return p.withColumn("vs", F.col("vs") * F.col("vs"))


# The square of a line has twice its squared slope as second derivative, at the one-sided ends too.
C.add("w14_curvature_prior", "profile segments", lambda p, _: _rounded(M.curvature_prior(_squared(p), 0.1)), "SELECT model_id, round(r, 6) AS rms, round(-0.5 * (r / 0.1) * (r / 0.1), 6) AS log_prior FROM (SELECT model_id, sqrt(sum((bottom - top) * pow(2 * s * s, 2)) / sum(bottom - top)) AS r FROM (SELECT *, CASE WHEN profile = 'constant' THEN 0 ELSE (v_bottom - v_top) / (bottom - top) END AS s FROM segments) GROUP BY model_id)")
C.add("w14_soft_priors", "profile segments", lambda p, _: _rounded(M.soft_priors(_squared(p), {"curvature": {"sigma": 0.1}})), "SELECT model_id, round(r, 6) AS curvature_rms, round(-0.5 * (r / 0.1) * (r / 0.1), 6) AS log_curvature, round(-0.5 * (r / 0.1) * (r / 0.1), 6) AS log_prior FROM (SELECT model_id, sqrt(sum((bottom - top) * pow(2 * s * s, 2)) / sum(bottom - top)) AS r FROM (SELECT *, CASE WHEN profile = 'constant' THEN 0 ELSE (v_bottom - v_top) / (bottom - top) END AS s FROM segments) GROUP BY model_id)")
_LAYERS = f"""WITH s AS (SELECT *, CAST(ceil((bottom - top) / 1.5 - 1e-9) AS INT) AS n FROM segments), e AS (SELECT *, unnest(range(n)) AS j FROM s), f AS (SELECT *, (bottom - top) / n AS h, top + (j + 0.5) * (bottom - top) / n AS z FROM e), g AS (SELECT model_id, seg, j, h AS thickness, {_VALUE.format(d='z')} AS vs FROM f UNION ALL SELECT model_id, 4, 0, 0, v_bottom FROM segments WHERE seg = 3),
v AS (SELECT *, CASE WHEN vs BETWEEN 0 AND 4.5 THEN 0.9409 + 2.0947 * vs - 0.8206 * vs**2 + 0.2683 * vs**3 - 0.0251 * vs**4 END AS vp FROM g)
SELECT model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY seg, j) - 1 AS INT) AS layer, round(thickness, 9) AS thickness, round(vs, 9) AS vs, round(vp, 9) AS vp, round(1.6612 * vp - 0.4721 * vp**2 + 0.0671 * vp**3 - 0.0043 * vp**4 + 0.000106 * vp**5, 9) AS rho FROM v"""
C.add("w15_layers_from_profile", "segments", lambda s: _rounded(M.layers_from_profile(s, 1.5), 9), _LAYERS)
C.add("w16_layers_from_tops", "segments", lambda s: _rounded(M.layers_from_tops(s.select("model_id", F.col("top").alias("depth"), "v_top"))), "SELECT model_id, top AS depth, round(v_top, 6) AS v_top, CASE WHEN seg = 3 THEN 0 ELSE bottom - top END AS thickness FROM segments")
C.add("w21_segments_from_samples", "segments", lambda s: _rounded(M.segments_from_samples(s.select("model_id", F.col("top").alias("depth"), F.col("v_top").alias("vs")))), "SELECT model_id, CAST(seg AS INT) AS seg, top, bottom, 'gradient' AS profile, round(v_top, 6) AS v_top, round(nxt, 6) AS v_bottom FROM (SELECT *, lead(v_top) OVER (PARTITION BY model_id ORDER BY seg) AS nxt FROM segments) WHERE seg < 3")


def _bounds(d):
    return d.sparkSession.createDataFrame([("vs1", 1.0, 45.0), ("vs2", 0.0, 0.09), ("vs3", 0.0, 0.07)], "parameter string, low double, high double")


C.add("p17_parameter_prior", "long_draws", lambda d: M.parameter_prior(d, _bounds(d)).select("station", "chain", "step", (F.col("log_prior") == 0).alias("valid")), "SELECT station, chain, step, bool_and(CASE parameter WHEN 'vs1' THEN value BETWEEN 1 AND 45 WHEN 'vs2' THEN value BETWEEN 0 AND 0.09 ELSE value BETWEEN 0 AND 0.07 END) AS valid FROM long_draws GROUP BY station, chain, step")


_KNOTS = [0.0, 1.0, 3.0, 7.0, 15.0]


def _j14(s):
    basis = M.basis_table(s.sparkSession, 6, 3, _KNOTS, 1.2)
    return M.spline_profile(s.select("model_id", F.col("seg").cast("int").alias("j"), F.col("v_top").alias("value")).unionByName(s.filter("seg > 1").select("model_id", (F.col("seg") + 2).cast("int").alias("j"), F.col("v_bottom").alias("value"))), basis)


_BASIS = ", ".join(f"({j}, {d!r}::DOUBLE, {float(b)!r}::DOUBLE)" for d, row in zip(_KNOTS, M.bspline_basis(6, 3, np.array(_KNOTS) / 15.0, 1.2), strict=True) for j, b in enumerate(row))
C.add("j14_spline_profile", "segments", lambda s: _rounded(_j14(s)), f"SELECT model_id, depth, round(sum(value * b), 6) AS vs FROM (SELECT model_id, seg AS j, v_top AS value FROM segments UNION ALL SELECT model_id, seg + 2, v_bottom FROM segments WHERE seg > 1) c JOIN (VALUES {_BASIS}) t(j, depth, b) USING (j) GROUP BY model_id, depth")


_DEPTHS = sorted({float(t + (b - t) * q / 4) for t, b in ((0, 1), (1, 3), (3, 7), (7, 15)) for q in range(5)})


def _weighted(p):
    return p.repartition("model_id").groupBy("model_id", "depth").agg(F.max("vs").alias("vs")).withColumn("weight", 1 + F.col("depth") / 5), M.basis_table(p.sparkSession, 5, 3, _DEPTHS)


C.add("a32_fit_spline", "profile", lambda p: _rounded(M.fit_spline_coefficients(*_weighted(p), 1e-3), 4))
_SUMS = ", ".join(f"({j}, {d!r}::DOUBLE, {float(b)!r}::DOUBLE)" for d, row in zip(_DEPTHS, M.bspline_basis(5, 3, np.array(_DEPTHS) / 15.0), strict=True) for j, b in enumerate(row) if b)
C.add(
    "a32_normal_sums",
    "profile",
    lambda p: _rounded(M.spline_normal_sums(*_weighted(p)), 4),
    f"WITH s AS (SELECT model_id, depth, max(vs) AS vs, 1 + depth / 5 AS w FROM profile GROUP BY model_id, depth), f(j, depth, b) AS (VALUES {_SUMS}) SELECT model_id, a.j AS i, b.j AS j, round(sum(w * w * a.b * b.b), 4) AS a FROM s JOIN f a USING (depth) JOIN f b USING (depth) WHERE a.j <= b.j GROUP BY model_id, a.j, b.j UNION ALL SELECT model_id, -1, j, round(sum(w * w * b * vs), 4) FROM s JOIN f USING (depth) GROUP BY model_id, j",
)

_ROWS = "SELECT coalesce(o.station, p.station) AS station, coalesce(o.model_id, p.model_id) AS model_id, coalesce(o.period, p.period) AS period, value, sigma, predicted, value IS NULL OR predicted IS NULL AS unmatched FROM (SELECT o.*, model_id FROM obs o JOIN (SELECT DISTINCT station, model_id FROM pred) m USING (station)) o FULL JOIN pred p ON p.station = o.station AND p.model_id = o.model_id AND p.period = o.period"
C.add("j9_residual_join", "obs pred", lambda o, p: P.residual_join(o, p).drop("observable", "sigma"), f"SELECT station, model_id, period, value, predicted, unmatched FROM ({_ROWS})")
_FIT = f"SELECT station, model_id, count(*) AS n, CASE WHEN NOT bool_or(unmatched) THEN sum(pow((predicted - value) / sigma, 2)) END AS chi2 FROM ({_ROWS}) GROUP BY station, model_id"


def _fits(o, p):
    return P.gaussian_fit(P.residual_join(o, p), 0.5)


C.add("a24_gaussian_fit", "obs pred", lambda o, p: _rounded(_fits(o, p).drop("observable")), f"SELECT station, model_id, n, round(chi2, 6) AS chi2, round(sqrt(chi2 / n), 6) AS misfit, round(0.5 * chi2, 6) AS weighted_chi2, round(-0.25 * chi2, 6) AS log_likelihood FROM ({_FIT})")


def _a25(o, p):
    f = _fits(o, p)
    both = f.unionByName(f.withColumn("observable", F.lit("skipped")))
    d = P.joint_fit(both, p, {"skipped": 0.0})
    return _rounded(d.select("station", "model_id", "n", "chi2", "misfit", F.when(F.col("valid"), F.col("log_likelihood")).alias("log_likelihood"), "valid"))


C.add("a25_joint_fit", "obs pred", _a25, f"SELECT station, model_id, n, round(chi2, 6) AS chi2, round(sqrt(chi2 / n), 6) AS misfit, round(-0.25 * chi2, 6) AS log_likelihood, chi2 IS NOT NULL AS valid FROM ({_FIT})")


def _a33(o, p):
    prior = p.select("station", "model_id").distinct().withColumn("log_prior", F.when(F.col("model_id") % 4 == 0, float("-inf")).otherwise(-1.0))
    d = P.posterior_table(prior, P.joint_fit(_fits(o, p), p))
    return _rounded(d.select("station", "model_id", F.when(F.col("error").isNull(), F.col("log_posterior")).alias("log_posterior"), "error"))


C.add("a33_posterior_table", "obs pred", _a33, f"SELECT station, model_id, CASE WHEN model_id % 4 <> 0 THEN round(-1 - 0.25 * chi2, 6) END AS log_posterior, CASE WHEN model_id % 4 = 0 THEN 'prior' WHEN chi2 IS NULL THEN 'fit' END AS error FROM ({_FIT})")
_Q = ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{round(100 * q):02d}" for q in P.QUANTILES)
C.add("a26_ensemble_summary", "long_draws", lambda d: _rounded(P.ensemble_summary(d, ("station", "parameter"))), f"SELECT station, parameter, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, {_Q} FROM long_draws GROUP BY station, parameter")
_QS = ", ".join(f"round(quantile_cont(vs1, {q}), 6) AS q{round(100 * q):02d}" for q in P.QUANTILES)
C.add("a26_exact_quantiles", "draws", lambda d: _rounded(P.exact_quantiles(d, ("chain",), "vs1")), f"SELECT chain, {_QS} FROM draws GROUP BY chain")
C.add("a27_best_draw", "draws", lambda d: _rounded(P.best_draw(d)), "SELECT station, chain, step, round(log_prob, 6) AS log_prob, accepted, vs1, vs2, vs3 FROM draws QUALIFY row_number() OVER (PARTITION BY station ORDER BY log_prob DESC, chain, step) = 1")
C.add("a28_acceptance", "draws", lambda d: _rounded(P.acceptance(d)), "SELECT station, chain, round(r, 6) AS rate, round(avg(r) OVER (PARTITION BY station), 6) AS mean_rate FROM (SELECT station, chain, avg(accepted::INT) AS r FROM draws GROUP BY station, chain)")
C.add("a29_retained_draws", "draws", lambda d: P.retained_draws(d, 10, 3).select("station", "chain", "step", "draw"), "SELECT station, chain, step, CAST((step - 10) / 3 AS INT) AS draw FROM draws WHERE step >= 10 AND (step - 10) % 3 = 0")


def _a34(d, long):
    kept = P.retained_draws(d, 10, 3)
    parameter = M.parameter_prior(long, _bounds(d))
    hard = d.select(*P.DRAW, F.when(F.col("vs1") > 2, 0.0).otherwise(float("-inf")).alias("log_prior"))
    soft = d.select(*P.DRAW, (-0.5 * F.col("vs2") * F.col("vs2")).alias("log_prior"))
    out = P.prior_decomposition(kept, parameter, hard, soft)
    return _rounded(out.select(*P.DRAW, r6("log_soft").alias("log_soft"), F.when(F.col("valid"), F.col("log_prior")).alias("log_prior"), "valid"))


C.add("a34_prior_decomposition", "draws long_draws", _a34, "SELECT station, chain, step, round(-0.5 * vs2 * vs2, 6) + 0.0 AS log_soft, CASE WHEN ok THEN round(-0.5 * vs2 * vs2, 6) + 0.0 END AS log_prior, ok AS valid FROM (SELECT *, vs1 BETWEEN 1 AND 45 AND vs2 BETWEEN 0 AND 0.09 AND vs3 BETWEEN 0 AND 0.07 AND vs1 > 2 AS ok FROM draws) WHERE step >= 10 AND (step - 10) % 3 = 0")
