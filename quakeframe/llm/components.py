"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: every larger neighbour of a node moves to the smallest one; small: every smaller neighbour, and the node itself."""
    pairs = _neighbours(edges) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    moved = joined.filter(F.col("v") > F.col("u")) if large else joined
    found = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        found = found.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b); the root is the component's smallest node.

    Each round is written to the shared checkpoint folder. Rounds grow with the logarithm of a component's diameter.
    Loops are ignored and repeated edges count once; no edges give an empty result.
    """
    now = common.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = common.cut(_star(_star(now, True), False))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = state
