"""Registering an operator on its view together with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import view, with_views


class Catalog:
    """Queries of one area."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def add(self, name: str, views: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
        """``build`` takes the views (named in one string) as DataFrames; ``sql`` reads them by name."""
        names = views.split()
        self.QUERIES[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, n) for n in names])
        if sql is not None:
            self.ORACLES[name] = with_views(names, sql)


def r6(x: Column | str) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)
