"""Registered queries against their SQL on the smallest tables, and the entry point."""

import math

import duckdb
import pytest

import __spark_entry__
from quakeframe import registry
from quakeframe.bindings import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in (*TABLES, "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    def plain(x):
        if x is None or isinstance(x, bool):
            return x
        if isinstance(x, float) or hasattr(x, "as_integer_ratio") or type(x).__name__ in ("int32", "int64", "Decimal"):
            return None if math.isnan(float(x)) else round(float(x), 5) + 0.0
        return str(x)

    cols = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def close(a, b):
    return len(a) == len(b) and all((abs(x - y) <= 2e-5 * max(1, abs(x))) if isinstance(x, float) and isinstance(y, float) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert close(rows(got), rows(want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
