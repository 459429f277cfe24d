"""Curve operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as K
from .base import Catalog, r6

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES


def _rounded(df, n=6):
    return df.select(*[(F.round(c, n) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in df.dtypes])


_REF = "CASE WHEN period <= 1 + 2.5 * 24 THEN 2.5 + 0.05 * (period - 1) / 2.5 ELSE 2.5 + 0.05 * (period - 1) / 2.5 END"
C.add("j6_interpolate_at", "curves ref_curve", lambda c, r: _rounded(K.interpolate_at(r, c.select("curve", "period"))), f"SELECT curve, period, round({_REF}, 6) AS reference FROM curves")


def _j6k(c):
    nodes, asked = c.filter("CAST(period AS INT) % 3 = 0"), c.filter("CAST(period AS INT) % 3 <> 0").select("curve", "period")
    out = None
    for m in ("linear", "clamp", "null"):
        d = K.interpolate_at(nodes, asked, keys=("curve",), extrapolate=m).withColumn("mode", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return _rounded(out)


_BR = """WITH n AS (SELECT curve, period AS x, velocity AS y, lead(period) OVER w AS x1, lead(velocity) OVER w AS y1, lag(period) OVER w AS x0, lag(velocity) OVER w AS y0 FROM curves WHERE CAST(period AS INT) % 3 = 0 WINDOW w AS (PARTITION BY curve ORDER BY period)),
q AS (SELECT curve, period FROM curves WHERE CAST(period AS INT) % 3 <> 0),
e AS (SELECT curve, min(x) AS lo, max(x) AS hi FROM n GROUP BY curve),
j AS (SELECT q.curve, q.period, lo, hi, n.* EXCLUDE (curve) FROM q LEFT JOIN e USING (curve) LEFT JOIN n ON n.curve = q.curve AND (n.x < q.period AND q.period < n.x1 OR q.period < lo AND n.x = lo OR q.period > hi AND n.x = hi)),
v AS (SELECT curve, period, CASE WHEN period > hi THEN y0 + (period - x0) * (y - y0) / (x - x0) ELSE y + (period - x) * (y1 - y) / (x1 - x) END AS linear, CASE WHEN period < lo OR period > hi THEN y ELSE y + (period - x) * (y1 - y) / (x1 - x) END AS clamp, CASE WHEN period BETWEEN lo AND hi THEN y + (period - x) * (y1 - y) / (x1 - x) END AS nothing FROM j)
SELECT curve, period, round(linear, 6) AS reference, 'linear' AS mode FROM v UNION ALL SELECT curve, period, round(clamp, 6), 'clamp' FROM v UNION ALL SELECT curve, period, round(nothing, 6), 'null' FROM v"""
C.add("j6_interpolate_keyed", "curves", _j6k, _BR)
_CURV = "SELECT *, coalesce(((y1 - velocity) / (x1 - x) - (velocity - y0) / (x - x0)) / (x1 - x0), 0) AS curvature, row_number() OVER (PARTITION BY curve ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY curve) - 1 AS n FROM (SELECT *, ln(period) AS x, lag(ln(period)) OVER w AS x0, lead(ln(period)) OVER w AS x1, lag(velocity) OVER w AS y0, lead(velocity) OVER w AS y1 FROM curves WINDOW w AS (PARTITION BY curve ORDER BY period))"
C.add("w5_curvature", "curves", lambda c: c.transform(K.curvature_log_period).select("curve", "period", r6("curvature").alias("curvature")), f"SELECT curve, period, round(curvature, 6) AS curvature FROM ({_CURV})")
C.add(
    "w6_longest_branch",
    "curves",
    lambda c: K.longest_branch(c, 60.0).select("curve", "period"),
    f"WITH c AS ({_CURV}), b AS (SELECT curve, i, coalesce(lead(i) OVER (PARTITION BY curve ORDER BY i), i) AS j FROM c WHERE abs(curvature) > 60 OR i = 0 OR i = n), s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY curve ORDER BY j - i DESC, i) = 1) SELECT c.curve, period FROM c JOIN s ON c.curve = s.curve AND c.i BETWEEN s.i AND s.j",
)


def _w9(c, r):
    return _rounded(K.select_cycle_shift(K.interpolate_at(r, c.withColumn("distance", F.lit(100.0))), 3))


_W9 = f"""WITH d AS (SELECT *, {_REF} AS reference, 100.0::DOUBLE AS distance FROM curves), e AS (SELECT *, (distance / velocity - distance / reference) / period AS res, unnest(range(-3, 4)) AS s FROM d), g AS (SELECT *, 1 / velocity + s * period / distance AS slow FROM e),
c AS (SELECT curve, s, median(abs(res + s)) AS score, min(slow) AS least, sqrt(avg(pow(1 / slow - reference, 2))) AS rmse FROM g GROUP BY curve, s), r AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY score, abs(s), s) AS k FROM c WHERE least > 0),
b AS (SELECT curve, max(CASE WHEN k = 1 THEN s END) AS shift, max(CASE WHEN k = 1 THEN score END) AS score, max(CASE WHEN k = 2 THEN score END) - max(CASE WHEN k = 1 THEN score END) AS gap, max(CASE WHEN k = 1 THEN rmse END) AS rmse FROM r WHERE k <= 2 GROUP BY curve),
m AS (SELECT curve, sqrt(avg(pow(velocity - reference, 2))) AS before, count(*) AS n FROM d GROUP BY curve)
SELECT curve, CAST(coalesce(shift, 0) AS INT) AS shift, round(score, 6) AS score, round(gap, 6) AS gap, round(before, 6) AS rmse_before, round(rmse, 6) AS rmse_after, n AS n_valid, CASE WHEN n < 2 THEN 'insufficient_reference' WHEN abs(coalesce(shift, 0)) = 3 THEN 'search_limit_reached' WHEN NOT coalesce(score <= 0.25, false) THEN 'reference_misfit' WHEN NOT coalesce(gap >= 0.1, false) THEN 'ambiguous' WHEN shift <> 0 THEN 'corrected' ELSE 'unchanged' END AS status FROM m LEFT JOIN b USING (curve)"""
C.add("w9_select_cycle_shift", "curves ref_curve", _w9, _W9)


def _w8(c, r):
    return _rounded(K.unwrap_phase(c.select("curve", "period", F.col("velocity").alias("group_velocity"), (F.col("amplitude") / 10).alias("phase"), F.lit(300.0).alias("distance")), r))


_W8 = f"""WITH RECURSIVE p AS (SELECT curve, period, velocity AS u, amplitude / 10 AS ph, 300.0::DOUBLE AS d, {_REF} AS c0, 2 * pi() / period AS o, row_number() OVER (PARTITION BY curve ORDER BY period DESC) AS k FROM curves),
f AS (SELECT curve, k, period, o, u, o * d / (o * d / u - (ph + round_even((o * d / u - o / c0 * d - ph) / (2 * pi()), 0) * 2 * pi())) AS c FROM p WHERE k = 1
UNION ALL SELECT p.curve, p.k, p.period, p.o, p.u, p.o * d / (p.o * d / p.u - ph + round_even((ph - (p.o * d / p.u - (f.o / f.c + (p.o - f.o) * (1 / p.u + 1 / f.u) / 2) * d)) / (2 * pi()), 0) * 2 * pi()) FROM f JOIN p ON p.curve = f.curve AND p.k = f.k + 1)
SELECT curve, period, round(c, 6) AS phase_velocity FROM f"""
C.add("w8_unwrap_phase", "curves ref_curve", _w8, _W8)
C.add("o1_strided_top_k", "curves", lambda c: K.strided_top_k(c, ["curve"], ["amplitude", "period"], 4, 3).select("curve", "period"), "SELECT curve, period FROM (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY amplitude, period) AS k FROM curves) WHERE (k - 1) % 4 = 0 AND k <= 12")
C.add("o2_top_candidate", "curves", lambda c: _rounded(K.top_candidate_with_gap(c, ["curve"], ["velocity", "period"], "velocity", ("period",))), "SELECT curve, max(CASE WHEN k = 1 THEN period END) AS period, round(max(CASE WHEN k = 1 THEN velocity END), 6) AS velocity, round(max(CASE WHEN k = 2 THEN velocity END) - max(CASE WHEN k = 1 THEN velocity END), 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY velocity, period) AS k FROM curves) GROUP BY curve")
C.add("o3_sort_curve", "curves", lambda c: _rounded(K.sort_curve(c)), "SELECT curve, period, round(velocity, 6) AS velocity, round(amplitude, 6) AS amplitude FROM curves ORDER BY curve, period")
C.add(
    "a23_branch_qc",
    "curves",
    lambda c: _rounded(K.branch_qc(c.select("curve", F.col("period").alias("target_period"), (F.col("period") * (1 + F.col("amplitude") / 200)).alias("instant_period"), "velocity", "amplitude", F.lit(100).alias("initial_count")), 0.2, 0.6)),
    "SELECT curve, 100 AS initial_count, count(*) AS retained_count, count(*) AS valid_points, round(median(period * amplitude / 200), 6) AS period_abs_median, round(median(amplitude / 200), 6) AS period_rel_median, round(max(amplitude / 200), 6) AS period_rel_max, round(min(velocity), 6) AS velocity_min, round(max(velocity), 6) AS velocity_max, max(amplitude) AS amplitude_max, count(*) / 100 AS retained_fraction, max(period * (1 + amplitude / 200) - period) IS NOT NULL AND max((period * (1 + amplitude / 200) - period) / period) > 0.2 AS warn_period, count(*) / 100 < 0.6 AS warn_short FROM curves GROUP BY curve",
)
_J8A = "SELECT *, distance / (distance / velocity + k * period) AS c FROM (SELECT *, 100.0::DOUBLE AS distance, unnest(range(-2, 3)) AS k FROM curves)"
C.add(
    "j8_phase_candidates",
    "curves",
    lambda c: _rounded(K.phase_candidates(c.select("curve", "period", F.col("velocity").alias("phase_velocity"), "amplitude", F.lit(100.0).alias("distance")), 2, (2.0, 6.0, 0.1))),
    f"WITH a AS (SELECT * FROM ({_J8A}) WHERE c BETWEEN 2 AND 6), g AS (SELECT curve, period, 2 + i * 0.1::DOUBLE AS velocity, sum(amplitude * exp(-0.5 * pow((2 + i * 0.1::DOUBLE - c) / 0.15, 2))) AS x FROM a CROSS JOIN range(41) r(i) GROUP BY curve, period, i) SELECT curve, period, round(velocity, 6) AS velocity, round(x / CASE WHEN max(x) OVER w = 0 THEN 1 ELSE max(x) OVER w END, 6) AS amplitude FROM g WINDOW w AS (PARTITION BY curve, period)",
)


def _j7(s):
    bank = s.select("trace_id", F.lit(1.0).alias("period"), "i", "t", F.abs("v").alias("envelope"))
    return _rounded(K.energy_map(bank, s.select("trace_id").distinct().withColumn("distance", F.lit(40.0)), (1.0, 4.0, 0.25)).drop("period"))


C.add("j7_energy_map", "samples", _j7, "WITH c AS (SELECT trace_id, 1 + j * 0.25::DOUBLE AS velocity, (40 / (1 + j * 0.25::DOUBLE) + 5) / 0.5 AS x FROM (SELECT DISTINCT trace_id FROM samples) CROSS JOIN range(13) r(j)), m AS (SELECT trace_id, velocity, CASE WHEN x = floor(x) THEN abs(a.v) ELSE abs(a.v) + (x - floor(x)) * (abs(b.v) - abs(a.v)) END AS amp FROM c LEFT JOIN samples a USING (trace_id) LEFT JOIN samples b USING (trace_id) WHERE a.i = floor(x) AND b.i = a.i + 1 UNION ALL SELECT trace_id, velocity, NULL FROM c WHERE floor(x) >= 63 AND NOT x = 63) SELECT trace_id, velocity, round(amp / max(amp) OVER (PARTITION BY trace_id), 6) AS amplitude FROM m")


def _k4(p):
    d = p.groupBy("source").agg((F.max("snr") * 3 + 2).alias("max_period"))
    out = None
    for m, kw in (("list", {"periods": (3.0, 5.0, 8.0, 13.0, 21.0)}), ("geomspace", {"dfreq": 0.3}), ("uniform", {"step": 2.0}), ("uniform_count", {"count": 5})):
        e = K.period_grid(d, m.split("_")[0], 2.0, **kw).select("source", F.lit(m).alias("mode"), "target_period")
        out = e if out is None else out.unionByName(e)
    return _rounded(out, 3)


_K4 = "WITH d AS (SELECT source, max(snr) * 3 + 2 AS hi FROM paths GROUP BY source), g AS (SELECT *, greatest(3, floor(ln(hi / 2) / 0.3)) AS n FROM d) SELECT source, 'list' AS mode, x AS target_period FROM d, (SELECT unnest([3.0::DOUBLE, 5, 8, 13, 21]) AS x) WHERE x BETWEEN 2 AND hi UNION ALL SELECT source, 'geomspace', round(2 * pow(hi / 2, i / (n - 1)), 3) FROM g, range(50) r(i) WHERE i < n UNION ALL SELECT source, 'uniform', x FROM (SELECT source, round(2 + 2.0::DOUBLE * i, 3) AS x, hi FROM d, range(100) r(i)) WHERE x <= hi + 1e-9 UNION ALL SELECT source, 'uniform', round(hi, 3) FROM d WHERE 2 + 2 * floor((hi - 2) / 2 + 1e-9) < hi UNION ALL SELECT source, 'uniform_count', round(2 + i * (hi - 2) / 4, 3) FROM d, range(5) r(i)"
C.add("k4_period_grid", "paths", _k4, _K4)
