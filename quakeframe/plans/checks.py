"""Contract checks and masks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts as V
from ..operators import masks as M
from .base import Catalog, r6
from .scalars import vincenty_sql

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES

NINE = ("ZZ", "ZN", "ZE", "NZ", "NN", "NE", "EZ", "EN", "EE")
# The bindings hold the contracts by construction, so some checks run on keys that leave out a column.
C.add("v1_unique_paths", "paths", lambda p: V.check_unique_paths(p, ("component", "source", "receiver")), "SELECT 'repeated_path' AS rule, 'ZZ|' || source || '|' || receiver AS key, CAST(count(*) AS STRING) AS detail FROM paths GROUP BY source, receiver HAVING count(*) > 1")
C.add("v2_station_coordinates", "paths", lambda p: V.check_station_coordinates(p.withColumn("src_lon", F.col("src_lon") + F.col("period_s") * 1e-7), 1.5e-6).select("rule", "key"), "SELECT 'station_moves' AS rule, source AS key FROM paths GROUP BY source HAVING max(src_lon + period_s * 1e-7) - min(src_lon + period_s * 1e-7) > 1.5e-6")
C.add("v3_ranges", "paths", lambda p: V.check_ranges(p.withColumns({"c": F.col("c") - 3, "rcv_lat": F.col("rcv_lat") + 41})), "SELECT unnest(list_filter([CASE WHEN rcv_lat + 41 > 90 THEN 'rcv_lat_range' END, CASE WHEN c - 3 <= 0 THEN 'c_positive' END], lambda x: x IS NOT NULL)) AS rule, 'ZZ|' || source || '|' || receiver || '|' || period_s AS key, 'out of range' AS detail FROM paths")


def _v4(paths):
    x, y = S.local_xy(F.col("rcv_lon"), F.col("rcv_lat"), F.col("src_lon"), F.col("src_lat"))
    return V.check_distances(paths.withColumn("distance_km", F.hypot(x, y)), 20.0).select("rule", "key")


C.add(
    "v4_distances",
    "paths",
    _v4,
    f"SELECT 'distance' AS rule, source || '|' || receiver AS key FROM ({vincenty_sql('(SELECT DISTINCT source, receiver, src_lon, src_lat, rcv_lon, rcv_lat FROM paths)', 'source, receiver, src_lon, src_lat, rcv_lon, rcv_lat', 'src_lon', 'src_lat', 'rcv_lon', 'rcv_lat')}) WHERE abs(distance_km - sqrt(pow(radians(rcv_lon - src_lon) * cos(radians(src_lat)) * {S.EARTH_RADIUS_KM}, 2) + pow(radians(rcv_lat - src_lat) * {S.EARTH_RADIUS_KM}, 2))) > 20",
)
C.add("v5_segments", "segments", lambda d: V.check_segments(d.withColumn("top", F.when(F.col("model_id") % 7 == 0, F.col("top") + F.col("seg")).otherwise(F.col("top")))).select("rule", "key"), "SELECT CASE WHEN bottom <= top + seg THEN 'thickness' ELSE 'not_contiguous' END AS rule, model_id || '|' || seg AS key FROM segments WHERE model_id % 7 = 0 AND seg > 0")
C.add("v6_layers", "layers", lambda d: V.check_layers(d.withColumn("vp", F.when(F.col("model_id") % 5 == 0, F.col("vs") * 0.9).otherwise(F.col("vp")))), "SELECT 'vp_above_vs' AS rule, model_id || '|' || layer AS key, 'layer' AS detail FROM layers WHERE model_id % 5 = 0")
C.add("v7_component_shapes", "ccf", lambda d: V.check_component_shapes(d, NINE), "SELECT 'missing_component' AS rule, CAST(pair AS STRING) AS key, array_to_string(list_sort(list_filter(['ZZ', 'ZN', 'ZE', 'NZ', 'NN', 'NE', 'EZ', 'EN', 'EE'], lambda x: NOT list_contains(have, x))), ',') AS detail FROM (SELECT pair, list(DISTINCT component) AS have FROM ccf GROUP BY pair) WHERE len(have) < 9")
C.add("j12_missing_rows", "paths", lambda p: V.missing_combinations(p, ["source", "receiver"], ["period_s"]), "SELECT source, receiver, period_s FROM (SELECT DISTINCT source, receiver FROM paths) CROSS JOIN (SELECT DISTINCT period_s FROM paths) EXCEPT SELECT source, receiver, period_s FROM paths")

C.add("f1_valid_measurements", "paths", lambda p: M.valid_measurements(p, 10.0).select("source", "receiver", "period_s", r6("c").alias("c")), "SELECT source, receiver, period_s, round(c, 6) AS c FROM paths WHERE c > 0 AND valid AND snr >= 10")


def _f2(d):
    cond = {"adjacent": F.col("i_lat") % 7 == 0, "unstable": F.col("value") > 95, "coverage": F.col("i_lon") % 5 == 0, "velocity": F.col("value") < 20, "near_source": F.col("i_lon") < 3, "curvature": F.col("value").between(50, 60), "boundary": F.col("i_lat") > 37}
    return d.select("period_s", "i_lat", "i_lon", M.first_reason(cond, F.col("period_s") == 35).cast("int").alias("reason"))


C.add("f2_first_reason", "field", _f2, "SELECT period_s, i_lat, i_lon, CASE WHEN period_s = 35 THEN 8 WHEN i_lat % 7 = 0 THEN 4 WHEN value > 95 THEN 1 WHEN i_lon % 5 = 0 THEN 2 WHEN value < 20 THEN 3 WHEN i_lon < 3 THEN 5 WHEN value BETWEEN 50 AND 60 THEN 6 WHEN i_lat > 37 THEN 7 ELSE 0 END AS reason FROM field")
C.add(
    "f3_helmholtz_reason",
    "field",
    lambda d: d.select("period_s", "i_lat", "i_lon", M.helmholtz_reason(F.col("i_lat") % 4, F.when(F.col("i_lat") != 12, F.col("value")), F.when(F.col("i_lon") % 11 != 5, (F.col("x_km") - 200) / 1500), F.lit(0.28), 3.0, F.col("i_lon") % 9 == 0, F.col("period_s") != 35, F.col("i_lon") % 13 == 7, 30.0).cast("int").alias("reason")),
    "SELECT period_s, i_lat, i_lon, CASE WHEN period_s = 35 THEN 1 WHEN i_lat % 4 <> 0 THEN 2 WHEN value <= 30 OR i_lat = 12 OR i_lon % 13 = 7 THEN 4 WHEN i_lon % 9 = 0 THEN 3 WHEN i_lon % 11 = 5 OR abs((x_km - 200) / 1500) > 1 / 9.0::DOUBLE THEN 5 WHEN 0.28::DOUBLE * 0.28::DOUBLE - (x_km - 200) / 1500 <= 0 THEN 6 ELSE 0 END AS reason FROM field",
)
C.add(
    "f4_near_source",
    "paths",
    lambda p: M.near_source(p.withColumnsRenamed({"rcv_lon": "lon", "rcv_lat": "lat"}), 3.0, 3.0).select("source", "receiver", "period_s", "near"),
    f"SELECT source, receiver, period_s, distance_km < 9.0 * period_s AS near FROM ({vincenty_sql('paths', 'source, receiver, period_s, src_lon, src_lat, rcv_lon, rcv_lat', 'src_lon', 'src_lat', 'rcv_lon', 'rcv_lat')})",
)
C.add("f5_boundary_cells", "field", lambda d: M.boundary_cells(d, 40, 40, 3).select("period_s", "i_lat", "i_lon", "boundary"), "SELECT period_s, i_lat, i_lon, i_lat < 3 OR i_lat >= 37 OR i_lon < 3 OR i_lon >= 37 AS boundary FROM field")
C.add("f6_snr_select", "traces", lambda t: M.snr_select(t, 4.0).select("trace_id").withColumn("side", F.lit("kept")).union(M.snr_select(t, 4.0, True).select("trace_id", F.lit("reverse"))), "SELECT trace_id, CASE WHEN snr >= 4 THEN 'kept' ELSE 'reverse' END AS side FROM traces")
C.add("f6_slowness_select", "traces", lambda t: M.slowness_select(t, 0.05, 0.08).select("trace_id", r6("slowness").alias("slowness")), "SELECT trace_id, round(slowness, 6) AS slowness FROM traces WHERE slowness BETWEEN 0.05 AND 0.08")
C.add("f8_source_acceptance", "event_cells", lambda d: M.source_acceptance(d, 50, 20, 0.45), "SELECT period_s, source, CAST(sum(CASE WHEN reason = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, n_valid > 0 AND n_valid >= 20 AND n_valid / 50 >= 0.45 AS accepted FROM event_cells GROUP BY period_s, source")
