"""Trace, selection and H-k operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hk as H
from ..operators import robust as R
from ..operators import traces as T
from .base import Catalog
from .scalars import vincenty_sql

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES

NINE = ("ZZ", "ZN", "ZE", "NZ", "NN", "NE", "EZ", "EN", "EE")


def _rounded(df, n=6):
    return df.select(*[(F.round(c, n) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in df.dtypes])


# J1: coefficients spelled out once more as SQL.
_SIN = {"c": "cos(radians(azimuth))", "s": "sin(radians(azimuth))", "C": "cos(radians(back_azimuth))", "S": "sin(radians(back_azimuth))", "1": "1.0"}
_ROT = " UNION ALL ".join(
    f"SELECT pair, '{out}' AS component, i, {len(terms)} AS need, v * ({sign} * {' * '.join(_SIN[x] for x in f)}) AS v FROM ccf WHERE component = '{src}'" for out, terms in T.ROTATION.items() for src, f, sign in terms
)
C.add("j1_rotate_components", "ccf", lambda d: _rounded(T.rotate_components(d)), f"SELECT pair, component, i, round(sum(v), 6) AS v FROM ({_ROT}) GROUP BY pair, component, i HAVING count(*) = max(need)")


def _j2(paths):
    each = paths.groupBy("source", "receiver", "src_lon", "src_lat", "rcv_lon", "rcv_lat").agg(*[F.max(c).alias(c) for c in ("snr", "amp", "c")])
    pairs = each.select(F.concat_ws("_", "source", "receiver").alias("pair"), "src_lon", "src_lat", "rcv_lon", "rcv_lat", F.when(F.col("snr") > 10, F.col("snr")).alias("header_az"), F.when(F.col("snr") > 8, F.col("snr") + 180).alias("header_baz"))
    over = each.filter("amp > 1.05").select(F.concat_ws("_", "source", "receiver").alias("pair"), F.col("c").alias("azimuth"), F.lit(None).cast("double").alias("back_azimuth"))
    return _rounded(T.resolve_azimuths(pairs, over).select("pair", "azimuth", "back_azimuth", "azimuth_source", "back_azimuth_source"))


C.add(
    "j2_resolve_azimuths",
    "paths",
    _j2,
    f"SELECT source || '_' || receiver AS pair, round(CASE WHEN amp > 1.05 THEN c WHEN snr > 10 THEN snr ELSE azimuth END, 6) AS azimuth, round(CASE WHEN snr > 10 THEN snr + 180 ELSE back_azimuth END, 6) AS back_azimuth, CASE WHEN amp > 1.05 THEN 'configured' WHEN snr > 10 THEN 'header' ELSE 'coordinates' END AS azimuth_source, CASE WHEN snr > 10 THEN 'header' ELSE 'coordinates' END AS back_azimuth_source FROM ({vincenty_sql('''(SELECT source, receiver, src_lon, src_lat, rcv_lon, rcv_lat, max(snr) AS snr, max(amp) AS amp, max(c) AS c FROM paths GROUP BY ALL)''', 'source, receiver, amp, c, snr, src_lon, src_lat, rcv_lon, rcv_lat', 'src_lon', 'src_lat', 'rcv_lon', 'rcv_lat')})",
)
C.add("u1_split_branches", "two_sided", lambda d: _rounded(T.split_branches(d, "both").unionByName(T.split_branches(d, "stack")).drop("one_sided")), "SELECT trace_id, 'positive' AS branch, lag, round(v, 6) AS v FROM two_sided WHERE lag >= 0 UNION ALL SELECT trace_id, 'negative', -lag, round(v, 6) FROM two_sided WHERE lag <= 0 UNION ALL SELECT trace_id, 'stack', abs(lag), round(CASE WHEN lag = 0 THEN max(v) ELSE avg(v) END, 6) FROM two_sided GROUP BY trace_id, abs(lag), lag = 0")
C.add("u2_symmetrize", "two_sided", lambda d: _rounded(T.symmetrize(d)), "SELECT trace_id, abs(lag) AS lag, round(sum(CASE WHEN lag = 0 THEN 2 * v ELSE v END), 6) AS v FROM two_sided GROUP BY trace_id, abs(lag)")


def _u3(paths):
    from ..operators.contracts import station_roles

    return station_roles(paths).distinct()


C.add("u3_stations_of", "paths", _u3, "SELECT source AS station, src_lon AS lon, src_lat AS lat FROM paths UNION SELECT receiver, rcv_lon, rcv_lat FROM paths")
C.add("s6_component_inventory", "ccf", lambda d: T.component_inventory(d.filter("i < 2 AND (component <> 'ZZ' OR i = 0) AND NOT (pair % 5 = 0 AND component = 'NE')"), NINE), "SELECT p AS pair, c AS component, CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS problem FROM (SELECT DISTINCT pair AS p FROM ccf) CROSS JOIN (SELECT unnest(['ZZ', 'ZN', 'ZE', 'NZ', 'NN', 'NE', 'EZ', 'EN', 'EE']) AS c) LEFT JOIN (SELECT pair, component, count(*) AS n FROM ccf WHERE i < 2 AND (component <> 'ZZ' OR i = 0) AND NOT (pair % 5 = 0 AND component = 'NE') GROUP BY ALL) x ON x.pair = p AND x.component = c WHERE n IS NULL OR n > 1")
C.add("a7_dedupe_median", "paths", lambda p: _rounded(R.dedupe_median(p, ("source", "period_s"), "rcv_lon", "rcv_lat", "c", 0)), "SELECT source, period_s, round(CASE WHEN twice THEN x ELSE rcv_lon END, 6) AS rcv_lon, round(CASE WHEN twice THEN y ELSE rcv_lat END, 6) AS rcv_lat, round(m, 6) AS c FROM (SELECT *, max(n) OVER g > 1 AS twice, count(*) OVER g AS points FROM (SELECT source, period_s, round(rcv_lon, 0) AS x, round(rcv_lat, 0) AS y, median(c) AS m, count(*) AS n, any_value(rcv_lon) AS rcv_lon, any_value(rcv_lat) AS rcv_lat FROM paths GROUP BY source, period_s, x, y) WINDOW g AS (PARTITION BY source, period_s)) WHERE points >= 3")
C.add("a8_block_median", "paths", lambda p: _rounded(R.block_median(p, ("period_s",), -10.0, 40.0, 0.7, "rcv_lon", "rcv_lat", "c").select("period_s", F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"), "rcv_lon", "rcv_lat", "c")), "SELECT period_s, CAST(floor((rcv_lon + 10) / 0.7::DOUBLE + 0.5) AS BIGINT) AS bx, CAST(floor((rcv_lat - 40) / 0.7::DOUBLE + 0.5) AS BIGINT) AS by, round(median(rcv_lon), 6) AS rcv_lon, round(median(rcv_lat), 6) AS rcv_lat, round(median(c), 6) AS c FROM paths GROUP BY 1, 2, 3")
C.add("a9_mad_outliers", "samples", lambda s: _rounded(R.mad_outliers(s)), "WITH v AS (SELECT station, trace_id, var_pop(v) AS x FROM samples WHERE t BETWEEN -5 AND 30 GROUP BY ALL), m AS (SELECT station, median(x) AS m FROM v GROUP BY station), d AS (SELECT station, median(abs(x - m)) * 1.4826 AS s FROM v JOIN m USING (station) GROUP BY station) SELECT station, trace_id, round(abs(x - m) / s, 6) AS score, abs(x - m) / s <= 2.5 AS kept FROM v JOIN m USING (station) JOIN d USING (station)")
C.add("a10_elliptical_mad", "hk_results", lambda d: R.elliptical_mad(d).select("rf_id", "kept"), "WITH m AS (SELECT station, median(h) AS mh, median(k) AS mk FROM hk_results GROUP BY station), d AS (SELECT station, greatest(median(abs(h - mh)) * 1.4826, 1e-6) AS sh, greatest(median(abs(k - mk)) * 1.4826, 1e-6) AS sk FROM hk_results JOIN m USING (station) GROUP BY station) SELECT rf_id, pow((h - mh) / sh, 2) + pow((k - mk) / sk, 2) < 4 AS kept FROM hk_results JOIN m USING (station) JOIN d USING (station)")
_MAHA = "WITH m AS (SELECT station, sum(energy * h) / sum(energy) AS mh, sum(energy * k) / sum(energy) AS mk FROM hk_results GROUP BY station), c AS (SELECT station, sum(energy * (h - mh) * (h - mh)) / sum(energy) AS a, sum(energy * (h - mh) * (k - mk)) / sum(energy) AS b, sum(energy * (k - mk) * (k - mk)) / sum(energy) AS c FROM hk_results JOIN m USING (station) GROUP BY station) "
_KEPT = "sqrt((c * (h - mh) * (h - mh) - 2 * b * (h - mh) * (k - mk) + a * (k - mk) * (k - mk)) / (a * c - b * b)) < 2"
C.add("a11_mahalanobis_select", "hk_results", lambda d: R.mahalanobis_select(d).select("rf_id", "kept"), _MAHA + f"SELECT rf_id, {_KEPT} AS kept FROM hk_results JOIN m USING (station) JOIN c USING (station)")
C.add("a12_energy_select", "hk_results", lambda d: R.energy_select(d).select("rf_id", "kept"), "SELECT rf_id, energy >= 0.5 * max(energy) OVER (PARTITION BY station) AS kept FROM hk_results")
C.add("a13_robust_summary", "hk_results", lambda d: _rounded(R.robust_summary(d)), "WITH x AS (SELECT * FROM hk_results), m AS (SELECT station, count(*) AS n, avg(h) AS ah, avg(k) AS ak, stddev_pop(h) AS sh, stddev_pop(k) AS sk, median(h) AS mh, median(k) AS mk FROM x GROUP BY station), d AS (SELECT station, median(abs(h - mh)) AS dh, median(abs(k - mk)) AS dk FROM x JOIN m USING (station) GROUP BY station) SELECT station, n, round(CASE WHEN n < 15 THEN ah ELSE mh END, 6) AS h_best, round(CASE WHEN n < 15 THEN sh ELSE dh END, 6) AS h_uncert, round(CASE WHEN n < 15 THEN ak ELSE mk END, 6) AS k_best, round(CASE WHEN n < 15 THEN sk ELSE dk END, 6) AS k_uncert FROM m JOIN d USING (station)")
C.add("a17_correlation_select", "samples", lambda s: _rounded(T.correlation_select(s, 0.1)), "WITH d AS (SELECT * FROM samples WHERE t BETWEEN -5 AND 30), m AS (SELECT station, i, avg(v) AS m FROM d GROUP BY station, i) SELECT station, trace_id, round(corr(v, m), 6) AS cc, corr(v, m) >= 0.1 AS kept FROM d JOIN m USING (station, i) GROUP BY station, trace_id")
C.add("a18_f_test_select", "samples", lambda s: _rounded(T.f_test_select(s), 5))
C.add("a19_p_amplitude_select", "samples", lambda s: _rounded(T.p_amplitude_select(s)), "SELECT trace_id, t AS time, round(v, 6) AS value, t BETWEEN -2 AND 2 AND v > 0 AS kept FROM samples WHERE t BETWEEN -5 AND 30 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY abs(v) DESC, t) = 1")
C.add("a20_late_energy_select", "samples", lambda s: _rounded(T.late_energy_select(s)), "SELECT trace_id, CASE WHEN p > 0 THEN round(q / p, 6) END AS q, coalesce(p > 0 AND q / p <= 0.3, false) AS kept FROM (SELECT trace_id, max(CASE WHEN t BETWEEN -2 AND 2 THEN v END) AS p, sqrt(avg(CASE WHEN t BETWEEN 2 AND 10 THEN v * v END)) AS q FROM samples GROUP BY trace_id)")


def _picks(t):
    return t.select("trace_id", F.lit(1.0).alias("period"), (F.lit(2.0) + F.col("trace_id") % 3).alias("group_velocity"), F.lit(24.0).alias("distance"))


def _a21(t, s):
    out = None
    for m in ("tail", "complement", "wide"):
        d = T.window_snr(s, _picks(t), m, wide=(2.0, 5.0, 1.0, 2.0)).withColumn("mode", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return _rounded(out)


_P21 = "(SELECT *, greatest(-5, 24 / u - 1) AS s0, least(26.5::DOUBLE, 24 / u + 1) AS s1 FROM (SELECT trace_id, 2.0::DOUBLE + trace_id % 3 AS u FROM traces))"
_N21 = f"(SELECT *, s1 + 5 - sh AS n0, s1 + 15 - sh AS n1 FROM (SELECT *, CASE WHEN s1 + 15 > 26.5 THEN least(s1 + 15 - 26.5, 5) ELSE 0 END AS sh FROM {_P21}))"
_WIDE = "(SELECT trace_id, 24 / 5.0::DOUBLE - 1 AS s0, 14.0::DOUBLE AS s1, 19 - 2.5::DOUBLE AS n0, 29 - 2.5::DOUBLE AS n1 FROM traces)"
_RATIO = "round(coalesce(max(CASE WHEN t BETWEEN s0 AND s1 THEN abs(v) END) / nullif(sqrt(avg(CASE WHEN {noise} THEN v * v END)), 0), 3.0), 6)"
C.add(
    "a21_window_snr",
    "traces samples",
    _a21,
    " UNION ALL ".join(f"SELECT trace_id, 1.0::DOUBLE AS period, {_RATIO.format(noise=n)} AS snr, '{m}' AS mode FROM samples JOIN {src} USING (trace_id) GROUP BY trace_id" for m, src, n in (("tail", _N21, "t BETWEEN n0 AND n1"), ("complement", _P21, "t < s0 - 1 OR t > s1 + 1"), ("wide", _WIDE, "t BETWEEN n0 AND n1"))),
)
C.add(
    "a22_peak_snr",
    "samples",
    lambda s: _rounded(T.peak_snr(s.withColumn("v", F.abs("v") + 0.01)).withColumn("i", F.col("i").cast("long"))),
    "WITH e AS (SELECT trace_id, i, abs(v) + 0.01::DOUBLE AS v FROM samples), n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY i)), p AS (SELECT trace_id, i AS p, v AS h, coalesce(lag(i) OVER w, 0) AS a, coalesce(lead(i) OVER w, 63) AS b FROM n WHERE l < v AND r < v WINDOW w AS (PARTITION BY trace_id ORDER BY i)) SELECT trace_id, p AS i, round(max(h) / sqrt(min(CASE WHEN i <= p THEN v END) * min(CASE WHEN i >= p THEN v END)), 6) AS snr FROM p JOIN e USING (trace_id) WHERE i BETWEEN a AND b GROUP BY trace_id, p",
)
C.add("a30_rms_snr", "samples", lambda s: _rounded(T.rms_snr(s, (0.0, 10.0), (-5.0, -1.0))), "SELECT trace_id, round(10 * log10(avg(CASE WHEN t BETWEEN 0 AND 10 THEN v * v END) / avg(CASE WHEN t BETWEEN -5 AND -1 THEN v * v END)), 6) AS snr FROM samples GROUP BY trace_id")
C.add("w17_detrend", "samples", lambda s: _rounded(T.detrend(s).select("trace_id", "i", "v")), "SELECT trace_id, i, round(v - (regr_intercept(v, i) OVER w + regr_slope(v, i) OVER w * i), 6) AS v FROM samples WINDOW w AS (PARTITION BY trace_id)")
C.add("w18_trim_and_pad", "samples", lambda s: _rounded(T.trim_and_pad(s.filter("i % 7 <> 3"), -5, 70)), "SELECT trace_id, CAST(k AS INT) AS i, round(coalesce(v, 0), 6) AS v FROM (SELECT DISTINCT trace_id FROM samples) CROSS JOIN range(-5, 71) r(k) LEFT JOIN (SELECT trace_id, i, v FROM samples WHERE i % 7 <> 3) s USING (trace_id) WHERE s.i = k OR s.i IS NULL".replace("USING (trace_id) WHERE s.i = k OR s.i IS NULL", "USING (trace_id)").replace("LEFT JOIN (SELECT trace_id, i, v FROM samples WHERE i % 7 <> 3) s USING (trace_id)", "LEFT JOIN (SELECT trace_id, i AS k, v FROM samples WHERE i % 7 <> 3) s USING (trace_id, k)"))
C.add(
    "w19_merge_segments",
    "samples",
    lambda s: _rounded(T.merge_segments(s.select(F.col("station").alias("channel"), F.col("trace_id").alias("segment"), (F.col("trace_id") * 50).alias("start"), (F.col("trace_id") * 50 + F.col("i")).alias("i"), "v"))),
    "WITH s AS (SELECT station AS channel, trace_id * 50 + i AS k, v, trace_id FROM samples QUALIFY row_number() OVER (PARTITION BY station, trace_id * 50 + i ORDER BY trace_id DESC) = 1), r AS (SELECT channel, unnest(range(min(k), max(k) + 1)) AS k FROM s GROUP BY channel) SELECT channel, k AS i, round(coalesce(v, 0), 6) AS v FROM r LEFT JOIN s USING (channel, k)",
)
C.add("j11_event_windows", "catalog records", lambda c, r: T.event_windows(c, r).select("event_id", "record_id"), "SELECT event_id, record_id FROM catalog JOIN records ON t BETWEEN origin AND origin + INTERVAL 2 HOURS")


def _f7(t, s):
    return T.qc_chain(t, s, {"snr": {"threshold": 3.0}, "slowness": {"low": 0.045, "high": 0.095}, "p_amplitude": {"tmin": -5.0, "tmax": 12.0}, "mad": {}, "correlation": {"threshold": 0.1}}).groupBy("failed_step").agg(F.count("*").alias("n"))


C.add(
    "f7_qc_chain",
    "traces samples",
    _f7,
    "WITH a AS (SELECT trace_id, station FROM traces WHERE snr >= 3), b AS (SELECT a.* FROM a JOIN traces USING (trace_id) WHERE slowness BETWEEN 0.045 AND 0.095), p AS (SELECT trace_id, t, v FROM samples WHERE t BETWEEN -5 AND 30 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY abs(v) DESC, t) = 1), c AS (SELECT b.* FROM b JOIN p USING (trace_id) WHERE t BETWEEN -5 AND 12 AND v > 0), v AS (SELECT station, trace_id, var_pop(v) AS x FROM samples WHERE t BETWEEN -5 AND 30 AND trace_id IN (SELECT trace_id FROM c) GROUP BY ALL), m AS (SELECT station, median(x) AS m FROM v GROUP BY station), d AS (SELECT station, median(abs(x - m)) * 1.4826 AS s FROM v JOIN m USING (station) GROUP BY station), e AS (SELECT trace_id FROM v JOIN m USING (station) JOIN d USING (station) WHERE abs(x - m) / CASE WHEN s > 0 THEN s ELSE 1e-12 END <= 2.5), g AS (SELECT s.* FROM samples s JOIN e USING (trace_id) WHERE t BETWEEN -5 AND 30), h AS (SELECT station, i, avg(v) AS m FROM g GROUP BY station, i), k AS (SELECT trace_id FROM g JOIN h USING (station, i) GROUP BY trace_id HAVING corr(g.v, h.m) >= 0.1), s AS (SELECT CASE WHEN trace_id NOT IN (SELECT trace_id FROM a) THEN 'snr' WHEN trace_id NOT IN (SELECT trace_id FROM b) THEN 'slowness' WHEN trace_id NOT IN (SELECT trace_id FROM c) THEN 'p_amplitude' WHEN trace_id NOT IN (SELECT trace_id FROM e) THEN 'mad' WHEN trace_id NOT IN (SELECT trace_id FROM k) THEN 'correlation' END AS failed_step FROM traces) SELECT failed_step, count(*) AS n FROM s GROUP BY failed_step",
)

def _f7_all(t, s):
    """All six steps; the F test has no SQL form."""
    return T.qc_chain(t, s, {"snr": {"threshold": 3.0}, "slowness": {"low": 0.045, "high": 0.095}, "p_amplitude": {"tmin": -5.0, "tmax": 12.0}, "mad": {}, "f_test": {}, "correlation": {"threshold": 0.1}}).select("trace_id", "failed_step")


C.add("f7_qc_chain_six_steps", "traces samples", _f7_all)

_H, _K = (0.0, 5.0, 0.25), (1.5, 3.0, 0.1)


def _cells(t, s):
    return H.hk_stack(t, s, H.hk_axes(t.sparkSession, _H, _K), vp=2.5)


def _surfaces(t, s):
    return H.hk_surfaces(t, s, H.hk_axes(t.sparkSession, _H, _K), vp=2.5)


_NK = len(H.search_axis(*_K))
_AX = f"SELECT CAST(i AS INT) AS h_idx, CAST(j AS INT) AS k_idx, i * 0.25::DOUBLE AS h, 1.5::DOUBLE + j * 1.5::DOUBLE / {_NK - 1} AS k FROM range(21) a(i) CROSS JOIN range({_NK}) b(j)"
_AT = "CAST(greatest(0, least(63, ceil(({d} + 5) / 0.5::DOUBLE - 0.5))) AS INT)"
_CELLS = f"""SELECT q.trace_id, q.station, h_idx, k_idx, h, k, (0.6::DOUBLE * a.v + 0.3::DOUBLE * b.v - 0.1::DOUBLE * c.v) * (151.5478::DOUBLE * slowness * slowness + 3.2896::DOUBLE * slowness + 0.2618::DOUBLE) AS amp FROM (SELECT *, {_AT.format(d='(qs - qp) * h')} AS ia, {_AT.format(d='(qs + qp) * h')} AS ib, {_AT.format(d='2 * qs * h')} AS ic FROM (SELECT *, sqrt(1 / ((2.5::DOUBLE / k) * (2.5::DOUBLE / k)) - slowness * slowness) AS qs, sqrt(1 / (2.5::DOUBLE * 2.5::DOUBLE) - slowness * slowness) AS qp FROM traces CROSS JOIN ({_AX}))) q JOIN samples a ON a.trace_id = q.trace_id AND a.i = ia JOIN samples b ON b.trace_id = q.trace_id AND b.i = ib JOIN samples c ON c.trace_id = q.trace_id AND c.i = ic"""
C.add("j10_stack_lookup", "traces", lambda t: t.crossJoin(F.broadcast(H.hk_axes(t.sparkSession, _H, _K))).select("trace_id", "h_idx", "k_idx", H.stack_lookup(F.col("h") * 3 + F.col("k") + F.col("slowness") * 10, F.col("b"), F.col("delta"), F.lit(64)).alias("place")), f"SELECT trace_id, h_idx, k_idx, {_AT.format(d='(h * 3 + k + slowness * 10)')} AS place FROM traces CROSS JOIN ({_AX})")
C.add("a14_hk_stack", "traces samples", lambda t, s: _rounded(H.best_of(_surfaces(t, s))), f"SELECT trace_id, station, round(h, 6) AS h, round(k, 6) AS k, round(amp, 6) AS energy FROM ({_CELLS}) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY round(amp, 12) DESC, k_idx, h_idx) = 1")
C.add("a16_mean_hk_surface", "traces samples", lambda t, s: _rounded(H.mean_surface(_surfaces(t, s))), f"SELECT station, h_idx, k_idx, round(avg(amp / CASE WHEN top = 0 THEN 1 ELSE top END), 6) AS amp FROM (SELECT *, max(amp) OVER (PARTITION BY trace_id) AS top FROM ({_CELLS})) GROUP BY station, h_idx, k_idx")
_SURFACE = f"SELECT station, h_idx, k_idx, avg(amp / CASE WHEN top = 0 THEN 1 ELSE top END) AS amp FROM (SELECT *, max(amp) OVER (PARTITION BY trace_id) AS top FROM ({_CELLS})) GROUP BY station, h_idx, k_idx"


def _smooth_sql(source: str, axis: str, other: str, n: int) -> str:
    """One pass of a Gaussian of 1.5 places and radius 6 along an axis, reflected about its ends."""
    place = f"((({axis} + o) % {2 * n}) + {2 * n}) % {2 * n}"
    return f"SELECT a.station, a.{other}, a.p AS {axis}, sum(w * s.amp) AS amp FROM (SELECT station, {other}, {axis} AS p, w, CASE WHEN m < {n} THEN m ELSE {2 * n - 1} - m END AS q FROM (SELECT *, {place} AS m FROM ({source}) CROSS JOIN (SELECT o, exp(-0.5 * o * o / 2.25) / sum(exp(-0.5 * o * o / 2.25)) OVER () AS w FROM range(-6, 7) r(o)))) a JOIN ({source}) s ON s.station = a.station AND s.{other} = a.{other} AND s.{axis} = a.q GROUP BY ALL"


C.add(
    "w20_smooth_surface",
    "traces samples",
    lambda t, s: _rounded(H.smooth_surface(H.mean_surface(_surfaces(t, s)), 21, _NK, keys=("station",)).select("station", "h_idx", "k_idx", "smooth")),
    f"WITH f AS ({_SURFACE}), g AS ({_smooth_sql('SELECT * FROM f', 'h_idx', 'k_idx', 21)}), k AS ({_smooth_sql('SELECT * FROM g', 'k_idx', 'h_idx', _NK)}) SELECT station, h_idx, k_idx, round(amp, 6) AS smooth FROM k",
)


def _ranges(d):
    """One search range a station, from its results."""
    tenth = lambda f, c: f(F.col(c) * 10).cast("double") / 10
    ends = d.groupBy("station").agg(F.floor(F.min("h")).cast("double").alias("h0"), F.ceil(F.max("h")).cast("double").alias("h1"), F.min("k").alias("least"), F.max("k").alias("most"))
    return ends.select("station", "h0", "h1", tenth(F.floor, "least").alias("k0"), tenth(F.ceil, "most").alias("k1"))


C.add(
    "w23_search_axis",
    "hk_results",
    lambda d: _rounded(H.axes_of(_ranges(d), 0.75, 0.07, ("station",))),
    "WITH r AS (SELECT station, floor(min(h)) AS h0, ceil(max(h)) AS h1, floor(min(k) * 10) / 10 AS k0, ceil(max(k) * 10) / 10 AS k1 FROM hk_results GROUP BY station), n AS (SELECT *, CAST(floor((h1 - h0) / 0.75::DOUBLE) AS INT) AS nh, CAST(floor((k1 - k0) / 0.07::DOUBLE) AS INT) AS nk FROM r), e AS (SELECT *, unnest(range(nk + 1)) AS j FROM (SELECT *, unnest(range(nh + 1)) AS i FROM n)) SELECT station, CAST(i AS INT) AS h_idx, CAST(j AS INT) AS k_idx, round(CASE WHEN nh = 0 THEN h0 ELSE h0 + i * (h1 - h0) / nh END, 6) AS h, round(CASE WHEN nk = 0 THEN k0 ELSE k0 + j * (k1 - k0) / nk END, 6) AS k FROM e",
)


def _a15(t, s):
    ax = H.hk_axes(t.sparkSession, (0.0, 3.0, 0.25), (1.8, 3.0, 0.2)), H.hk_axes(t.sparkSession, (4.0, 8.0, 0.5), (1.6, 2.0, 0.1))
    sediment, crust = H.hk_sequence(t.filter("trace_id % 2 = 0"), t.filter("trace_id % 2 = 1"), s, s, *ax)
    return _rounded(sediment.withColumn("layer", F.lit("sediment")).unionByName(crust.withColumn("layer", F.lit("crust"))))


C.add("a15_hk_sequence", "traces samples", _a15)
