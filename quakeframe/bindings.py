"""Views of the driver's tables that feed the measurement operators.

Each view is SQL text that Spark and DuckDB read alike; where they differ (exploding arrays) both forms are given.
``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .session import deal, settle

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

#: Rows that views make of one row of a table, where there are many.
SPREAD = {"part": 20, "embeddings": 64}

VIEWS: dict[str, str | tuple[str, str]] = {
    "stations": """
SELECT 'S' || CAST(s_suppkey AS STRING) AS station, CAST(-10 + (s_suppkey * 37 % 200) * 0.1 AS DOUBLE) AS lon, CAST(40 + (s_suppkey * 53 % 100) * 0.1 AS DOUBLE) AS lat FROM {supplier}
UNION ALL SELECT 'R' || CAST(p_partkey AS STRING), CAST(-9.95 + (p_partkey * 29 % 200) * 0.1 AS DOUBLE), CAST(40.05 + (p_partkey * 71 % 100) * 0.1 AS DOUBLE) FROM {part}""",
    "paths": """
SELECT 'ZZ' AS component, 'S' || CAST(l_suppkey AS STRING) AS source, 'R' || CAST(l_partkey AS STRING) AS receiver,
 CAST(-10 + (l_suppkey * 37 % 200) * 0.1 AS DOUBLE) AS src_lon, CAST(40 + (l_suppkey * 53 % 100) * 0.1 AS DOUBLE) AS src_lat,
 CAST(-9.95 + (l_partkey * 29 % 200) * 0.1 AS DOUBLE) AS rcv_lon, CAST(40.05 + (l_partkey * 71 % 100) * 0.1 AS DOUBLE) AS rcv_lat,
 CAST(5 * l_linenumber AS INT) AS period_s, 2.5 + max(l_quantity) / 25 AS c, max(l_extendedprice) / 5000 AS snr, max(l_returnflag) <> 'R' AS valid, 1 + max(l_tax) AS amp
FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_linenumber""",
    "event_cells": """
SELECT CAST(5 * l_linenumber AS INT) AS period_s, CAST(l_partkey % 50 AS INT) AS cell, l_suppkey AS source, 0.2 + max(l_quantity) / 250 AS slowness,
 CAST((l_suppkey * 37 + (l_partkey % 50) * 11) % 360 - 180 AS DOUBLE) AS azimuth, CASE WHEN max(l_discount) >= 0.1 THEN 3 ELSE 0 END AS reason, true AS accepted
FROM {lineitem} GROUP BY l_linenumber, l_partkey % 50, l_suppkey""",
    "field": """
SELECT CAST(5 * l_linenumber AS INT) AS period_s, 0 AS source, CAST(l_suppkey % 40 AS INT) AS i_lat, CAST(l_partkey % 40 AS INT) AS i_lon,
 CAST(10 * (l_suppkey % 40) AS DOUBLE) AS y_km, CAST(10 * (l_partkey % 40) AS DOUBLE) AS x_km, max(l_extendedprice) / 1000 AS value
FROM {lineitem} GROUP BY l_linenumber, l_suppkey % 40, l_partkey % 40""",
    "curves": """
SELECT l_suppkey AS curve, CAST(1 + l_partkey % 60 AS DOUBLE) AS period, 2.5 + 0.02 * (1 + l_partkey % 60) + max(l_discount) AS velocity, max(l_quantity) AS amplitude
FROM {lineitem} GROUP BY l_suppkey, 1 + l_partkey % 60""",
    "ref_curve": "SELECT CAST(1 + 2.5 * n_nationkey AS DOUBLE) AS period, CAST(2.5 + 0.05 * n_nationkey AS DOUBLE) AS velocity FROM {nation}",
    "traces": """
SELECT vec_id AS trace_id, label AS station, CAST(-5 AS DOUBLE) AS b, CAST(0.5 AS DOUBLE) AS delta, CAST(0.04 + 0.0006 * (vec_id % 100) AS DOUBLE) AS slowness, CAST((vec_id * 13 % 100) / 10.0 AS DOUBLE) AS snr FROM {embeddings}""",
    "samples": (
        "SELECT vec_id AS trace_id, label AS station, i, CAST(-5 + 0.5 * i AS DOUBLE) AS t, CAST(x AS DOUBLE) AS v FROM {embeddings} LATERAL VIEW posexplode(embedding) p AS i, x",
        "SELECT vec_id AS trace_id, label AS station, i, CAST(-5 + 0.5 * i AS DOUBLE) AS t, CAST(x AS DOUBLE) AS v FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM {embeddings})",
    ),
    "ccf": """
SELECT CAST(floor(trace_id / 9) AS INT) AS pair, CASE CAST(trace_id % 9 AS INT) WHEN 0 THEN 'ZZ' WHEN 1 THEN 'ZN' WHEN 2 THEN 'ZE' WHEN 3 THEN 'NZ' WHEN 4 THEN 'NN' WHEN 5 THEN 'NE' WHEN 6 THEN 'EZ' WHEN 7 THEN 'EN' ELSE 'EE' END AS component, i, v,
 CAST(floor(trace_id / 9) * 37 AS INT) % 360 AS azimuth, (CAST(floor(trace_id / 9) * 37 AS INT) + 180) % 360 AS back_azimuth FROM {samples}""",
    "two_sided": "SELECT trace_id, CAST(i - 31 AS INT) AS lag, v FROM {samples} WHERE i < 63",
    "hk_results": """
SELECT o_orderkey AS rf_id, o_custkey % 50 AS station, 30 + o_totalprice / 25000 AS h, CAST(1.5 + (o_orderkey % 500) * 0.001 AS DOUBLE) AS k, CAST(1 + o_orderkey * 7 % 100 AS DOUBLE) AS energy FROM {orders}""",
    "draws": """
SELECT station, chain, CAST(row_number() OVER (PARTITION BY station, chain ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS step, log_prob, accepted, vs1, vs2, vs3
FROM (SELECT l_suppkey AS station, l_linenumber AS chain, -l_extendedprice / 1000 AS log_prob, l_returnflag = 'A' AS accepted, l_quantity AS vs1, l_discount AS vs2, l_tax AS vs3, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem}) q""",
    "long_draws": "SELECT station, chain, step, 'vs1' AS parameter, vs1 AS value FROM {draws} UNION ALL SELECT station, chain, step, 'vs2', vs2 FROM {draws} UNION ALL SELECT station, chain, step, 'vs3', vs3 FROM {draws}",
    "segments": """
SELECT p_partkey AS model_id, seg, CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom, CASE WHEN seg = 0 THEN 'constant' ELSE 'gradient' END AS profile, CAST(2.0 + p_size / 50.0 + 0.4 * seg AS DOUBLE) AS v_top, CAST(2.2 + p_retailprice / 4000 + 0.4 * seg AS DOUBLE) AS v_bottom
FROM {part} CROSS JOIN (SELECT 0 AS seg, 0 AS top, 1 AS bottom UNION ALL SELECT 1, 1, 3 UNION ALL SELECT 2, 3, 7 UNION ALL SELECT 3, 7, 15) s""",
    "layers": """
SELECT model_id, seg AS layer, CASE WHEN seg = 3 THEN CAST(0 AS DOUBLE) ELSE bottom - top END AS thickness, v_top AS vs, CAST(v_top * 1.75 AS DOUBLE) AS vp, CAST(2.7 AS DOUBLE) AS rho FROM {segments}""",
    "profile": "SELECT model_id, seg, d AS depth, CASE WHEN profile = 'constant' THEN v_top ELSE v_top + (v_bottom - v_top) * (d - top) / (bottom - top) END AS vs FROM (SELECT *, top + (bottom - top) * q / 4.0 AS d FROM {segments} CROSS JOIN (SELECT 0 AS q UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) z) y",
    "obs": "SELECT l_suppkey AS station, 'love' AS observable, CAST(l_linenumber AS DOUBLE) AS period, min(l_quantity) AS value, CAST(2 AS DOUBLE) AS sigma FROM {lineitem} GROUP BY l_suppkey, l_linenumber",
    "pred": "SELECT l_suppkey AS station, 'love' AS observable, l_partkey % 20 AS model_id, CAST(l_linenumber AS DOUBLE) AS period, max(l_quantity) AS predicted FROM {lineitem} GROUP BY l_suppkey, l_partkey % 20, l_linenumber",
    "contributions": """
SELECT l_suppkey AS station, l_linenumber AS frequency, max(l_quantity) AS rayleigh_h, max(l_extendedprice) / 10000 AS love_h, max(l_discount) AS psv_h, max(l_tax) AS sh_h, max(l_quantity) + max(l_discount) AS rayleigh_v, max(l_extendedprice) / 10000 + max(l_tax) AS psv_v FROM {lineitem} GROUP BY l_suppkey, l_linenumber""",
    "catalog": "SELECT event_id, ts AS origin, value AS magnitude FROM {events} WHERE event_type = 'purchase' AND value > 150",
    "records": "SELECT event_id AS record_id, user_id AS channel, ts AS t FROM {events} WHERE NOT (event_type = 'purchase' AND value > 150)",
}


def _text(name: str, duck: bool) -> str:
    v = VIEWS[name]
    return v[duck] if isinstance(v, tuple) else v


def _uses(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def _tables(name: str) -> set[str]:
    return {name} if name in TABLES else {t for u in _uses(_text(name, False)) for t in _tables(u)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame; the session's shuffles are dealt for the rows that come of its largest table."""
    settle(spark)
    deal(spark, max(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() * SPREAD.get(t, 1) for t in _tables(name)))
    return _view(spark, sf_dir, name)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _text(name, False)
    return spark.sql(sql, **{u: _view(spark, sf_dir, u) for u in _uses(sql)})


@cache
def _order(name: str) -> tuple[str, ...]:
    if name in TABLES:
        return ()
    return tuple(dict.fromkeys([x for u in _uses(_text(name, True)) for x in _order(u)] + [name]))


def with_views(names: list[str], sql: str) -> str:
    """DuckDB SQL with the views as common table expressions in front."""
    order = dict.fromkeys(x for n in names for x in _order(n))
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', _text(n, True)).strip()})" for n in order]
    own = sql.lstrip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(word):
            return f"{word}{', '.join([*parts, own[len(word):]])}"
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
