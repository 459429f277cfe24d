"""Stacks, grids and stencils on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid as G
from ..operators import stack as A
from .base import Catalog, r6
from .scalars import vincenty_sql

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES
MIN_RAW = 5

_VALID = "SELECT *, ((azimuth % 360) + 360) % 360 AS a FROM event_cells WHERE reason = 0 AND slowness > 0 AND accepted"
_PEERS = f"SELECT e.*, (SELECT count(*) FROM ({_VALID}) f WHERE f.period_s = e.period_s AND f.cell = e.cell AND least(abs(f.a - e.a), 360 - abs(f.a - e.a)) <= 20) AS peers FROM ({_VALID}) e"
_RAW_W = f"SELECT *, CASE WHEN peers >= 2 THEN 1.0::DOUBLE / peers END AS w0, count(*) OVER (PARTITION BY period_s, cell) AS raw FROM ({_PEERS})"
_WEIGHTS = f"SELECT * EXCLUDE (w0), CASE WHEN w0 IS NULL THEN 0 ELSE least(w0, avg(w0) OVER c + 3 * stddev_pop(w0) OVER c) END AS w FROM ({_RAW_W}) WINDOW c AS (PARTITION BY period_s, cell)"


def _norm(sql: str, w: str = "w") -> str:
    return f"SELECT * EXCLUDE (w), CASE WHEN sum({w}) OVER c > 0 THEN {w} / sum({w}) OVER c ELSE 0 END AS w FROM ({sql}) WINDOW c AS (PARTITION BY period_s, cell)"


_N0 = _norm(f"SELECT * REPLACE (CASE WHEN raw >= {MIN_RAW} THEN w ELSE 0 END AS w) FROM ({_WEIGHTS})")
_M0 = f"SELECT *, sum(w * slowness) OVER c / nullif(sum(w) OVER c, 0) AS m, count(CASE WHEN w > 0 THEN 1 END) OVER c AS nn FROM ({_N0}) WINDOW c AS (PARTITION BY period_s, cell)"
_S0 = f"SELECT *, CASE WHEN nn > 1 THEN sqrt(sum(w * (slowness - m) * (slowness - m)) OVER c / sum(w) OVER c * nn / (nn - 1)) END AS s FROM ({_M0}) WINDOW c AS (PARTITION BY period_s, cell)"
_CLIP = _norm(f"SELECT * REPLACE (CASE WHEN w > 0 AND s > 0 AND abs(slowness - m) > 3 * s THEN 0 ELSE w END AS w) FROM ({_S0})")
_F1 = f"SELECT *, sum(w * slowness) OVER c / nullif(sum(w) OVER c, 0) AS ms, sum(w / slowness) OVER c / nullif(sum(w) OVER c, 0) AS mv, CASE WHEN w > 0 THEN a END AS la FROM ({_CLIP}) WINDOW c AS (PARTITION BY period_s, cell)"
_F2 = f"SELECT *, la - lag(la) OVER (PARTITION BY period_s, cell ORDER BY la NULLS FIRST) AS gap FROM ({_F1})"
STACK_SQL = f"""SELECT period_s, cell, max(ms) AS slowness, count(CASE WHEN w > 0 THEN 1 END) AS n, CASE WHEN n > 1 THEN sqrt(sum(w * (slowness - ms) * (slowness - ms)) / sum(w) * n / (n - 1)) END AS slowness_std, CASE WHEN n > 1 THEN sqrt(sum(w * (1 / slowness - mv) * (1 / slowness - mv)) / sum(w) * n / (n - 1)) END AS vstd, coalesce(1 / nullif(sum(w * w), 0), 0) AS effective_count, max(raw) AS raw_count, CASE WHEN n < 2 THEN 0 ELSE 360 - greatest(max(gap), min(la) + 360 - max(la)) END AS coverage FROM ({_F2.replace('slowness', 'slowness')}) GROUP BY period_s, cell"""
_STACK = f"SELECT period_s, cell, round(slowness, 6) AS slowness, round(1 / slowness, 6) AS velocity, round(slowness_std, 6) AS slowness_std, CASE WHEN effective_count > 1 THEN round(vstd / sqrt(effective_count), 6) END AS velocity_sem, round(effective_count, 6) AS effective_count, raw_count, n AS count, round(coverage, 6) AS coverage, slowness IS NULL OR raw_count < {MIN_RAW} AS mask FROM ({STACK_SQL.replace('max(ms) AS slowness', 'max(ms) AS ms0').replace('AS ms0', 'AS slow')})".replace("round(slowness, 6)", "round(slow, 6)").replace("round(1 / slowness, 6)", "round(1 / slow, 6)").replace("slowness IS NULL OR", "slow IS NULL OR")


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else c for c, t in df.dtypes])


def _stack(d):
    return _rounded(A.stack_cells(d, min_raw_measurements_per_cell=MIN_RAW))


def _valid(d):
    return d.filter("reason = 0 AND slowness > 0 AND accepted")


C.add("a1_stack_cells", "event_cells", _stack, _STACK)
C.add("j5_azimuth_peers", "event_cells", lambda d: A.azimuth_peers(_valid(d), 20.0).select("period_s", "cell", "source", "peers"), f"SELECT period_s, cell, source, peers FROM ({_PEERS})")
C.add("a2_peer_weights", "event_cells", lambda d: A.peer_weights(_valid(d)).select("period_s", "cell", "source", r6("w").alias("w")), f"SELECT period_s, cell, source, round(w, 6) AS w FROM ({_WEIGHTS})")
C.add("a3_weighted_mean_std", "event_cells", lambda d: _rounded(A.weighted_mean_std(d.withColumn("w", F.pmod("source", F.lit(5)).cast("double")))), "SELECT period_s, cell, round(max(m), 6) AS mean, CASE WHEN count(*) > 1 THEN round(sqrt(sum(w * (slowness - m) * (slowness - m)) / sum(w) * count(*) / (count(*) - 1)), 6) END AS std, count(*) AS n FROM (SELECT *, sum(w * slowness) OVER c / sum(w) OVER c AS m FROM (SELECT *, source % 5 AS w FROM event_cells WHERE source % 5 > 0) WINDOW c AS (PARTITION BY period_s, cell)) GROUP BY period_s, cell")
C.add("a4_sigma_clip", "event_cells", lambda d: A.sigma_clip(A.normalize(d.withColumn("w", F.lit(1.0))), 1.5, 1).select("period_s", "cell", "source", r6("w").alias("w")), "SELECT period_s, cell, source, round(CASE WHEN abs(slowness - m) > 1.5 * s THEN 0 ELSE 1.0::DOUBLE / k END, 6) AS w FROM (SELECT *, count(CASE WHEN NOT abs(slowness - m) > 1.5 * s THEN 1 END) OVER c AS k FROM (SELECT *, stddev_samp(slowness) OVER c AS s, avg(slowness) OVER c AS m FROM event_cells WINDOW c AS (PARTITION BY period_s, cell)) WINDOW c AS (PARTITION BY period_s, cell))")
C.add("a5_effective_count", "event_cells", lambda d: A.stack_cells(d, min_raw_measurements_per_cell=MIN_RAW, clip_deviations=None, require_peer=False).select("period_s", "cell", r6("effective_count").alias("effective_count")), f"SELECT period_s, cell, CASE WHEN count(*) >= {MIN_RAW} THEN round(pow(sum(w), 2) / sum(w * w), 6) ELSE 0 END AS effective_count FROM (SELECT *, least(w0, avg(w0) OVER c + 3 * stddev_pop(w0) OVER c) AS w FROM (SELECT *, 1.0::DOUBLE / peers AS w0 FROM ({_PEERS})) WINDOW c AS (PARTITION BY period_s, cell)) GROUP BY period_s, cell")
C.add("a6_azimuthal_coverage", "event_cells", lambda d: _rounded(A.azimuthal_coverage(d)), "SELECT period_s, cell, CASE WHEN count(*) < 2 THEN 0 ELSE round(360 - greatest(max(gap), min(a) + 360 - max(a)), 6) END AS coverage FROM (SELECT *, a - lag(a) OVER (PARTITION BY period_s, cell ORDER BY a) AS gap FROM (SELECT *, ((azimuth % 360) + 360) % 360 AS a FROM event_cells)) GROUP BY period_s, cell")
C.add(
    "u4_eikonal_vs_helmholtz",
    "event_cells",
    lambda d: A.eikonal_vs_helmholtz(d.withColumns({"helmholtz_slowness": F.col("slowness") * 2, "helmholtz_reason": F.col("reason")}), min_raw_measurements_per_cell=MIN_RAW).select("period_s", "cell", r6("velocity").alias("velocity"), r6("helmholtz_velocity").alias("helmholtz_velocity")),
    f"SELECT period_s, cell, round(1 / slow, 6) AS velocity, round(1 / (2 * slow), 6) AS helmholtz_velocity FROM ({STACK_SQL.replace('max(ms) AS slowness', 'max(ms) AS slow')})",
)
C.add("a31_field_summary", "event_cells", lambda d: A.field_summary(d, (0, 3)), "SELECT period_s, source, CAST(sum(CASE WHEN reason = 0 THEN 1 ELSE 0 END) AS BIGINT) AS reason_0, CAST(sum(CASE WHEN reason = 3 THEN 1 ELSE 0 END) AS BIGINT) AS reason_3 FROM event_cells GROUP BY period_s, source")


def _s9(d):
    from ..operators.masks import source_acceptance

    return A.run_summary(source_acceptance(d, 50, 20, 0.45))


C.add("s9_run_summary", "event_cells", _s9, "SELECT period_s, CAST(sum(CASE WHEN n >= 20 AND n / 50 >= 0.45 THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted, count(*) AS n_sources FROM (SELECT period_s, source, sum(CASE WHEN reason = 0 THEN 1 ELSE 0 END) AS n FROM event_cells GROUP BY period_s, source) GROUP BY period_s")

LON, LAT = (-10.0, 10.0, 0.5), (40.0, 50.0, 0.5)
_GRID = "SELECT CAST(i AS INT) AS i_lat, CAST(j AS INT) AS i_lon, 40 + i * 0.5::DOUBLE AS lat, -10 + j * 0.5::DOUBLE AS lon FROM range(21) a(i) CROSS JOIN range(41) b(j)"


def _grid(df):
    return G.grid_axes(df.sparkSession, LON, LAT)




def _boxes(p):
    """One map box a period: the whole degrees around its sources and receivers."""
    ends = {f"{x}{i}": f(g(F.min(f"src_{x}") if i == 0 else F.max(f"src_{x}"), F.min(f"rcv_{x}") if i == 0 else F.max(f"rcv_{x}"))) for x in ("lon", "lat") for i, f, g in ((0, F.floor, F.least), (1, F.ceil, F.greatest))}
    return p.groupBy("period_s").agg(*[v.cast("double").alias(k) for k, v in ends.items()])


_BOX = "SELECT period_s, floor(least(min(src_lon), min(rcv_lon))) AS lon0, ceil(greatest(max(src_lon), max(rcv_lon))) AS lon1, floor(least(min(src_lat), min(rcv_lat))) AS lat0, ceil(greatest(max(src_lat), max(rcv_lat))) AS lat1 FROM paths GROUP BY period_s"
_ROWS = f"(SELECT *, lat0 + i_lat * 0.5::DOUBLE AS lat, (lon0 + lon1) / 2 AS middle FROM (SELECT *, CAST(unnest(range(CAST(round((lat1 - lat0) / 0.5) AS BIGINT) + 1)) AS INT) AS i_lat FROM ({_BOX})))"
_DX = vincenty_sql(_ROWS, "period_s, i_lat, lat, lon0, lon1", "lon0", "lat", "lon0 + 0.5", "lat")
_DY = vincenty_sql(_ROWS, "period_s, i_lat", "middle", "lat - 0.5", "middle", "lat")
C.add(
    "w4_grid_axes",
    "paths",
    lambda p: _rounded(G.grids_of(_boxes(p), 0.5, 0.5, ("period_s",))),
    f"SELECT x.period_s, x.i_lat, CAST(j AS INT) AS i_lon, x.lat AS lat, x.lon0 + j * 0.5::DOUBLE AS lon, round(j * x.distance_km, 6) AS x_km, round(y.y, 6) AS y_km FROM (SELECT *, unnest(range(CAST(round((lon1 - lon0) / 0.5) AS BIGINT) + 1)) AS j FROM ({_DX})) x JOIN (SELECT period_s, i_lat, sum(CASE WHEN i_lat = 0 THEN 0 ELSE distance_km END) OVER (PARTITION BY period_s ORDER BY i_lat) AS y FROM ({_DY})) y USING (period_s, i_lat)",
)
_XY = lambda lon, lat: (f"radians({lon}) * cos(radians(45)) * {S.EARTH_RADIUS_KM}", f"radians({lat} - 45) * {S.EARTH_RADIUS_KM}")


def _j3(paths, stations):
    return G.station_coverage(_grid(stations), paths, (0.0, 45.0), "either", 60.0, 120.0, 3)


_GX, _GY = _XY("lon", "lat")
_RX, _RY = _XY("rcv_lon", "rcv_lat")
C.add(
    "j3_station_coverage",
    "paths stations",
    _j3,
    f"WITH g AS ({_GRID}), gg AS (SELECT i_lat, i_lon, {_GX} AS gx, {_GY} AS gy FROM g), r AS (SELECT DISTINCT period_s, source, {_RX} AS rx, {_RY} AS ry FROM paths), k AS (SELECT DISTINCT period_s, source FROM r), h AS (SELECT period_s, source, i_lat, i_lon, bool_or(d <= 60) AS nearby, count(DISTINCT CASE WHEN d <= 120 THEN (rx - gx >= 0)::INT * 2 + (ry - gy >= 0)::INT END) AS q FROM (SELECT *, sqrt((rx - gx) * (rx - gx) + (ry - gy) * (ry - gy)) AS d FROM r CROSS JOIN gg) WHERE d <= 120 GROUP BY ALL) SELECT period_s, source, i_lat, i_lon, coalesce(nearby, false) OR coalesce(q, 0) >= 3 AS covered FROM k CROSS JOIN gg LEFT JOIN h USING (period_s, source, i_lat, i_lon)",
)
C.add(
    "j4_cells_by_source",
    "paths stations",
    lambda p, s: _rounded(G.cells_by_source(_grid(s), p.select("source", "src_lon", "src_lat").distinct()).select("source", "i_lat", "i_lon", "distance_km", "azimuth")),
    f"SELECT source, i_lat, i_lon, round(distance_km, 6) AS distance_km, round(azimuth, 6) AS azimuth FROM ({vincenty_sql(f'(SELECT * FROM (SELECT DISTINCT source, src_lon, src_lat FROM paths) CROSS JOIN ({_GRID}))', 'source, i_lat, i_lon, src_lon, src_lat, lon, lat', 'src_lon', 'src_lat', 'lon', 'lat')})",
)


def _gradient_sql(source: str, value: str, out: str, along: str, across: str, x: str) -> str:
    at = lambda c, k: f"CASE WHEN {'lead' if k > 0 else 'lag'}({along}, {abs(k)}) OVER w = {along} + {k} THEN {'lead' if k > 0 else 'lag'}({c}, {abs(k)}) OVER w END"
    end = lambda y1, y2, x1, x2: f"-(2 * ({x1} - {x}) + ({x2} - {x1})) / (({x1} - {x}) * ({x2} - {x})) * {value} + ({x2} - {x}) / (({x1} - {x}) * ({x2} - {x1})) * {y1} - ({x1} - {x}) / (({x2} - {x1}) * ({x2} - {x})) * {y2}"
    mid = f"(({x} - w1) * ({x} - w1) * y1 + ((x1 - {x}) * (x1 - {x}) - ({x} - w1) * ({x} - w1)) * {value} - (x1 - {x}) * (x1 - {x}) * z1) / (({x} - w1) * (x1 - {x}) * (x1 - w1))"
    return f"SELECT * EXCLUDE (y1, y2, z1, z2, x1, x2, w1, w2, lo, hi), CASE WHEN {along} = lo THEN {end('y1', 'y2', 'x1', 'x2')} WHEN {along} = hi THEN {end('z1', 'z2', 'w1', 'w2')} ELSE {mid} END AS {out} FROM (SELECT *, {at(value, 1)} AS y1, {at(value, 2)} AS y2, {at(value, -1)} AS z1, {at(value, -2)} AS z2, {at(x, 1)} AS x1, {at(x, 2)} AS x2, {at(x, -1)} AS w1, {at(x, -2)} AS w2, min({along}) OVER l AS lo, max({along}) OVER l AS hi FROM ({source}) WINDOW w AS (PARTITION BY period_s, source, {across} ORDER BY {along}), l AS (PARTITION BY period_s, source, {across}))"


_LON = ("i_lon", "i_lat", "x_km")
_LAT = ("i_lat", "i_lon", "y_km")
_G1 = _gradient_sql(_gradient_sql("SELECT * FROM field", "value", "east", *_LON), "value", "north", *_LAT)
C.add("w1_gradient", "field", lambda d: G.gradient(G.gradient(d, "lon", out="east"), "lat", out="north").select("period_s", "i_lat", "i_lon", F.round("east", 9).alias("east"), F.round("north", 9).alias("north")), f"SELECT period_s, i_lat, i_lon, round(east, 9) AS east, round(north, 9) AS north FROM ({_G1})")
_G2 = _gradient_sql(_gradient_sql(_G1, "east", "ee", *_LON), "north", "nn", *_LAT)
C.add("w2_laplacian", "field", lambda d: G.laplacian(d).select("period_s", "i_lat", "i_lon", F.round("laplacian", 9).alias("laplacian")), f"SELECT period_s, i_lat, i_lon, round(ee + nn, 9) AS laplacian FROM ({_G2})")
C.add("w3_adjacent_to_null", "field", lambda d: G.adjacent_to_null(G.full_grid(d, 40, 40)).select("period_s", "i_lat", "i_lon", "adjacent"), "WITH g AS (SELECT period_s, CAST(i AS INT) AS i_lat, CAST(j AS INT) AS i_lon, value FROM (SELECT DISTINCT period_s FROM field) CROSS JOIN range(40) a(i) CROSS JOIN range(40) b(j) LEFT JOIN field f USING (period_s) WHERE false UNION ALL SELECT k.period_s, CAST(a.i AS INT), CAST(b.j AS INT), f.value FROM (SELECT DISTINCT period_s FROM field) k CROSS JOIN range(40) a(i) CROSS JOIN range(40) b(j) LEFT JOIN field f ON f.period_s = k.period_s AND f.i_lat = a.i AND f.i_lon = b.j) SELECT g.period_s, g.i_lat, g.i_lon, g.value IS NOT NULL AND EXISTS (SELECT 1 FROM g h WHERE h.period_s = g.period_s AND abs(h.i_lat - g.i_lat) + abs(h.i_lon - g.i_lon) = 1 AND h.value IS NULL) AS adjacent FROM g")
