"""Scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .base import Catalog, r6

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES


def vincenty_sql(source: str, keep: str, lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Nested selects that add distance_km, azimuth and back_azimuth to the columns ``keep`` of ``source``."""
    f, a = repr(S.WGS84_F), repr(S.WGS84_A)
    b = repr(S.WGS84_A * (1 - S.WGS84_F))
    core = "s1, c1, s2, c2, l"
    sql = f"SELECT {keep}, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l, l AS lam FROM (SELECT {keep}, atan((1 - {f}) * tan(radians({lat1}))) AS u1, atan((1 - {f}) * tan(radians({lat2}))) AS u2, radians({lon2} - {lon1}) AS l FROM {source})"
    angles = "c2 * sin(lam) AS east, c1 * s2 - s1 * c2 * cos(lam) AS north, s1 * s2 + c1 * c2 * cos(lam) AS cs"
    for i in range(S.VINCENTY_STEPS + 1):
        sql = f"SELECT {keep}, {core}, lam, east, north, cs, sqrt(east * east + north * north) AS ss FROM (SELECT *, {angles} FROM ({sql}))"
        sql = f"SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM ({sql})"
        sql = f"SELECT *, CASE WHEN ca2 = 0 THEN 0 ELSE cs - 2 * s1 * s2 / ca2 END AS cm FROM (SELECT *, 1 - sa * sa AS ca2 FROM ({sql}))"
        if i < S.VINCENTY_STEPS:
            sql = f"SELECT *, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS cc FROM ({sql})"
            sql = f"SELECT {keep}, {core}, l + (1 - cc) * {f} * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam FROM ({sql})"
    sql = f"SELECT *, ca2 * (({a} * {a} - {b} * {b}) / ({b} * {b})) AS u FROM ({sql})"
    sql = f"SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS ba, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM ({sql})"
    wrap = lambda x: f"(({x}) + 180 - 360 * floor((({x}) + 180) / 360) - 180)"
    return f"SELECT {keep}, {b} * ba * (sigma - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS distance_km, {wrap('degrees(atan2(east, north))')} AS azimuth, CASE WHEN ss = 0 THEN 0 ELSE {wrap('degrees(atan2(c1 * sin(lam), c1 * s2 * cos(lam) - s1 * c2)) + 180')} END AS back_azimuth FROM ({sql})"


_PAIRS = "(SELECT DISTINCT source, receiver, src_lon, src_lat, rcv_lon, rcv_lat FROM paths)"
_GEO = vincenty_sql(_PAIRS, "source, receiver, src_lon, src_lat, rcv_lon, rcv_lat", "src_lon", "src_lat", "rcv_lon", "rcv_lat")


def _pairs(paths):
    return paths.select("source", "receiver", "src_lon", "src_lat", "rcv_lon", "rcv_lat").distinct()


def _geo(paths):
    return S.with_geodesic(_pairs(paths), "src_lon", "src_lat", "rcv_lon", "rcv_lat")


C.add("p1_geodesic", "paths", lambda p: _geo(p).select("source", "receiver", r6("g.distance_km").alias("distance_km"), r6("g.azimuth").alias("azimuth"), r6("g.back_azimuth").alias("back_azimuth")), f"SELECT source, receiver, round(distance_km, 6) AS distance_km, round(azimuth, 6) AS azimuth, round(back_azimuth, 6) AS back_azimuth FROM ({_GEO})")
C.add("p2_wrap180", "lineitem", lambda d: d.select((F.col("l_partkey") * 37 % 1080 - 540).alias("a")).distinct().select("a", r6(S.wrap180(F.col("a").cast("double"))).alias("wrapped")), "SELECT DISTINCT a, a + 180.0::DOUBLE - 360 * floor((a + 180) / 360) - 180 AS wrapped FROM (SELECT l_partkey * 37 % 1080 - 540 AS a FROM lineitem)")


def _p3(paths):
    x, y = S.local_xy(F.col("rcv_lon"), F.col("rcv_lat"), F.col("src_lon"), F.col("src_lat"))
    return _pairs(paths).select("source", "receiver", r6(x).alias("x_km"), r6(y).alias("y_km"))


C.add("p3_local_xy", "paths", _p3, f"SELECT source, receiver, round(radians(rcv_lon - src_lon) * cos(radians(src_lat)) * {S.EARTH_RADIUS_KM}, 6) AS x_km, round(radians(rcv_lat - src_lat) * {S.EARTH_RADIUS_KM}, 6) AS y_km FROM {_PAIRS}")
C.add(
    "p4_travel_time",
    "paths",
    lambda p: p.withColumn("d", (F.col("snr") * 10)).select("source", "receiver", "period_s", r6(S.travel_time(F.col("d"), F.col("c") - 3)).alias("t"), r6(S.slowness_to_velocity(F.col("c") - 3)).alias("v")),
    "SELECT source, receiver, period_s, CASE WHEN c > 3 THEN round(snr * 10 / (c - 3), 6) END AS t, CASE WHEN c > 3 THEN round(1 / (c - 3), 6) END AS v FROM paths",
)
C.add(
    "p5_gradient_angle",
    "field",
    lambda d: d.select("period_s", "i_lat", "i_lon", r6(S.apparent_slowness(F.col("value") - 50, F.col("x_km") - 100)).alias("slowness"), r6(S.propagation_angle(F.col("value") - 50, F.col("x_km") - 100)).alias("angle"), r6(S.wrap180(S.propagation_angle(F.col("value") - 50, F.col("x_km") - 100) - F.col("y_km"))).alias("deflection")),
    "SELECT period_s, i_lat, i_lon, round(sqrt((value - 50) * (value - 50) + (x_km - 100) * (x_km - 100)), 6) AS slowness, round(ang - 360 * floor((ang + 180) / 360), 6) AS angle, round(ang - y_km - 360 * floor((ang - y_km + 180) / 360), 6) AS deflection FROM (SELECT *, degrees(atan2(x_km - 100, value - 50)) AS ang FROM field)",
)
C.add(
    "p6_helmholtz",
    "field",
    lambda d: d.withColumn("corr", S.helmholtz_correction(F.col("value"), F.col("x_km") - 200, F.col("period_s"))).select("period_s", "i_lat", "i_lon", r6("corr").alias("correction"), r6(S.corrected_slowness(F.lit(0.3), F.col("corr"))).alias("slowness")),
    "SELECT period_s, i_lat, i_lon, round(corr, 6) AS correction, CASE WHEN 0.09::DOUBLE - corr > 0 THEN round(sqrt(0.3::DOUBLE * 0.3::DOUBLE - corr), 6) END AS slowness FROM (SELECT *, (x_km - 200) / (value * (2 * pi() / period_s) * (2 * pi() / period_s)) AS corr FROM field)",
)


def _alpha_sql(d: str) -> str:
    t = S.ALPHA_TABLE
    parts = [f"WHEN {d} <= {t[0][0]} THEN {t[0][1]}::DOUBLE"] + [f"WHEN {d} <= {x1} THEN {y0}::DOUBLE + ({d} - {x0}) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE" for (x0, y0), (x1, y1) in zip(t, t[1:], strict=False)]
    return f"CASE {' '.join(parts)} ELSE {t[-1][1]} END"


C.add(
    "p7_filter_alpha",
    "hk_results",
    lambda d: d.withColumn("d", F.col("h") * F.col("energy") * 3).select("rf_id", *[F.round(S.filter_alpha(F.col("d"), m), 4).alias(m) for m in ("table", "sqrt", "flat")]),
    f"SELECT rf_id, round({_alpha_sql('d')}, 4) AS \"table\", round(20 * sqrt(d / 1000), 4) AS sqrt, 20.0::DOUBLE AS flat FROM (SELECT *, h * energy * 3 AS d FROM hk_results)",
)
C.add("p8_effective_max_period", "hk_results", lambda d: d.select("rf_id", r6(S.effective_max_period(F.col("h") * F.col("energy"), 60.0)).alias("max_period")), "SELECT rf_id, round(least(60.0::DOUBLE, h * energy / 6.0), 6) AS max_period FROM hk_results")
C.add(
    "p9_physical_pair",
    "ccf",
    lambda d: d.select("pair", "component").distinct().withColumn("branch", F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("stack")), F.col("pair") % 3 + 1)).select("pair", "component", "branch", S.physical_component(F.col("component"), F.col("branch")).alias("physical"), S.physical_pair(F.lit("A"), F.lit("B"), F.col("branch"))["source"].alias("first"), S.physical_branch(F.col("branch")).alias("label"), S.pi_over_4(S.physical_component(F.col("component"), F.col("branch"))).alias("term")),
    "SELECT pair, component, branch, CASE WHEN branch = 'negative' THEN reverse(component) ELSE component END AS physical, CASE WHEN branch = 'negative' THEN 'B' ELSE 'A' END AS first, CASE WHEN branch = 'negative' THEN 'positive' ELSE branch END AS label, CASE CASE WHEN branch = 'negative' THEN reverse(component) ELSE component END WHEN 'ZZ' THEN -1.0::DOUBLE WHEN 'ZR' THEN 1.0 WHEN 'RZ' THEN -1.0 WHEN 'RR' THEN -1.0 WHEN 'TT' THEN -1.0 END AS term FROM (SELECT *, CASE pair % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'stack' END AS branch FROM (SELECT DISTINCT pair, component FROM ccf))",
)
_VP = "(0.9409 + 2.0947 * vs - 0.8206 * vs**2 + 0.2683 * vs**3 - 0.0251 * vs**4)"
_RHO = "(1.6612 * vp - 0.4721 * vp**2 + 0.0671 * vp**3 - 0.0043 * vp**4 + 0.000106 * vp**5)"
C.add(
    "p10_scaling",
    "segments",
    lambda d: d.select("model_id", "seg", r6(S.vp_from_vs(F.col("v_top") * 1.2)).alias("vp"), r6(S.rho_from_vs(F.col("v_top") * 1.2)).alias("rho"), r6(S.vp_from_vs(F.col("v_top"), "constant_vp_vs")).alias("vp_const")),
    f"SELECT model_id, seg, round(vp, 6) AS vp, round({_RHO}, 6) AS rho, round(v_top * 1.75, 6) AS vp_const FROM (SELECT *, CASE WHEN vs BETWEEN 0 AND 4.5 THEN {_VP} END AS vp FROM (SELECT *, v_top::DOUBLE * 1.2 AS vs FROM segments))",
)
C.add("p11_snr_db", "paths", lambda p: p.select("source", "receiver", "period_s", r6(S.snr_db(F.col("snr") - 10)).alias("db"), r6(S.snr_db(F.col("snr") - 10, decibel=False)).alias("ratio")), "SELECT source, receiver, period_s, CASE WHEN snr > 10 THEN round(20 * log10(snr - 10), 6) ELSE 3.0 END AS db, CASE WHEN snr > 10 THEN round(snr - 10, 6) ELSE 3.0 END AS ratio FROM paths")


def _p12(d):
    h = {k: F.col(f"{k}_h") for k in ("rayleigh", "love", "psv", "sh")}
    v = {k: F.col(f"{k}_v") for k in ("rayleigh", "psv")}
    return d.select("station", "frequency", r6(S.hv_ratio(h, v)["hv"]).alias("hv"), r6(S.hv_ratio(h, v, "mean")["hv"]).alias("hv_mean"), S.hv_ratio(h, v)["status"].alias("status"))


C.add("p12_hv_ratio", "contributions", _p12, "SELECT station, frequency, round(sqrt(hh / vv), 6) AS hv, round(sqrt(hh / 2 / vv), 6) AS hv_mean, 'ok' AS status FROM (SELECT *, 2 * (rayleigh_h + love_h + psv_h + sh_h) AS hh, rayleigh_v + psv_v AS vv FROM contributions)")
C.add(
    "p13_windows",
    "samples",
    lambda d: d.select("trace_id", "i", r6(S.taper(F.col("i").cast("double"), 4.0, 12.0, 40.0, 60.0)).alias("taper"), r6(S.gaussian_window(F.col("t"), F.lit(5.0), F.lit(2.0))).alias("gauss"), r6(S.gaussian_response(F.col("t") + 6, F.lit(10.0), F.lit(20.0))).alias("response")),
    "SELECT trace_id, i, round(CASE WHEN i <= 4 OR i >= 60 THEN 0 WHEN i < 12 THEN 0.5 * (1 - cos(pi() * (i - 4) / 8)) WHEN i <= 40 THEN 1 ELSE 0.5 * (1 + cos(pi() * (i - 40) / 20)) END, 6) AS taper, round(CASE WHEN -0.5 * ((t - 5) / 2) * ((t - 5) / 2) < -24 THEN 0 ELSE exp(-0.5 * ((t - 5) / 2) * ((t - 5) / 2)) END, 6) AS gauss, round(CASE WHEN -20 * ((t - 4) / 10) * ((t - 4) / 10) < -40 THEN 0 ELSE exp(-20 * ((t - 4) / 10) * ((t - 4) / 10)) END, 6) AS response FROM samples",
)
C.add(
    "p14_amp_correct",
    "traces samples",
    lambda t, s: s.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a")).join(t, "trace_id").select("trace_id", F.posexplode(F.arrays_zip(S.amp_correct(F.col("a.v"), F.col("slowness"), F.col("b"), F.col("delta")).alias("x"), S.amp_correct(F.col("a.v"), F.col("slowness"), F.col("b"), F.col("delta"), "max_amp").alias("y"))).alias("i", "z")).select("trace_id", F.col("i").cast("long").alias("i"), r6("z.x").alias("seispy"), r6("z.y").alias("max_amp")),
    "SELECT trace_id, i, round(v * (151.5478 * slowness * slowness + 3.2896 * slowness + 0.2618), 6) AS seispy, round(v / max(CASE WHEN t BETWEEN -2 AND 2 THEN abs(v) END) OVER (PARTITION BY trace_id), 6) AS max_amp FROM samples JOIN traces USING (trace_id)",
)
C.add("p15_log_likelihood", "draws", lambda d: d.select("station", "chain", "step", r6(S.log_likelihood(F.col("log_prob"), F.col("vs2"))).alias("log_likelihood")), "SELECT station, chain, step, round(log_prob - vs2, 6) AS log_likelihood FROM draws")


def _p16(s):
    from pyspark.sql import Window

    w = Window.partitionBy("trace_id").orderBy("i")
    d = s.withColumns({"l": F.lag("v").over(w), "r": F.lead("v").over(w)}).filter("l < v AND r < v")
    p = S.parabolic_peak(F.col("l"), F.col("v"), F.col("r"))
    return d.select("trace_id", "i", r6(p["offset"]).alias("peak_offset"), r6(p["value"]).alias("value"))


C.add("p16_parabolic_peak", "samples", _p16, "SELECT trace_id, i, round((l - r) / (l + r - 2 * v) / 2, 6) AS peak_offset, round(v - (l - r) * ((l - r) / (l + r - 2 * v) / 2) / 4, 6) AS value FROM (SELECT *, lag(v) OVER (PARTITION BY trace_id ORDER BY i) AS l, lead(v) OVER (PARTITION BY trace_id ORDER BY i) AS r FROM samples) WHERE l < v AND r < v")
