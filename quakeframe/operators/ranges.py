"""Groups of any size: rows dealt to tasks by ranges of their order, and what the ranges have to know of each other.

A window holds a group in one task. Here a group that is too large for that is cut where its order is cut by a range
partitioning; each range works on its own, and one row a range and group carries on to the next ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut

#: Rows of a group up to which one task holds it.
LARGE = 1 << 20


def aside(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with its keys under other names, for a join by ``same``."""
    return df.withColumnsRenamed({k: f"__{k}" for k in keys})


def same(keys: tuple[str, ...]) -> Column:
    """Equal keys, where NULL equals NULL."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])


def split_large(df: DataFrame, keys: tuple[str, ...], rows: int = LARGE, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rest, large): rows of groups of at most, and of more than, so many rows; None without such groups.

    Groups are counted once, in ``counted`` if given: a table of at least the rows of ``df`` whose keys are cheaper to read.
    """
    large = cut((df if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows).select(*keys))
    if large.isEmpty():
        return df, None
    marked = bounded(aside(large, keys))
    return df.join(marked, same(keys), "left_anti"), df.join(marked, same(keys), "left_semi")


Attach = Callable[[DataFrame, tuple[str, ...], dict[str, Column]], DataFrame]


def by_window(df: DataFrame, keys: tuple[str, ...], found: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of its group, for groups that one task holds."""
    cell = Window.partitionBy(*keys)
    return df.withColumns({n: a.over(cell) for n, a in found.items()})


def by_join(df: DataFrame, keys: tuple[str, ...], found: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of its group, summed on the map side and joined back; no rows of ``df`` move for it."""
    table = cut(df.groupBy(*keys).agg(*[a.alias(n) for n, a in found.items()]))
    return df.join(bounded(aside(table, keys)), same(keys)).drop(*[f"__{k}" for k in keys])


def in_ranges(df: DataFrame, order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """``df`` with ``__part``, the number of its range of ``order``: no row of a range lies before one of an earlier range.

    Equal rows share a range, so the caller counts repeated ones first. Written, so that all readers see the same ranges.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to and including itself; ``order`` has no ties within a group."""
    d = in_ranges(df, (*keys, *order), parts)
    own = (*keys, "__part")
    totals = d.groupBy(*own).agg(F.sum(value).alias("__total"))
    # One row a range and group: at most as many as groups and ranges together.
    earlier = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = cut(totals.select(*own, F.coalesce(earlier, F.lit(0)).alias("__before")))
    here = F.sum(value).over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = d.withColumn("__here", here).join(bounded(aside(before, own)), same(own))
    return joined.withColumn(out, F.coalesce("__here", F.lit(0)) + F.col("__before")).drop("__here", "__before", "__part", *[f"__{k}" for k in own])


def largest_gaps(df: DataFrame, keys: tuple[str, ...], value: str, parts: int | None = None) -> DataFrame:
    """(keys, lo, hi, gap): the ends of a group's values and the largest difference of neighbouring ones; NULLs are ignored."""
    d = in_ranges(df.filter(F.col(value).isNotNull()).select(*keys, value).distinct(), (*keys, value), parts)
    own = (*keys, "__part")
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*own).orderBy(value))
    ends = d.withColumn("__step", step).groupBy(*own).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max("__step").alias("gap"))
    across = F.col("lo") - F.lag("hi").over(Window.partitionBy(*keys).orderBy("__part"))
    return ends.withColumn("__across", across).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.greatest("gap", "__across")).alias("gap"))


def border_nodes(d: DataFrame, x: str, node: str) -> DataFrame:
    """(__part, __ca2, __ca, __cb, __cb2): for each range of ``d`` the last two nodes before it and the first two behind it.

    ``node`` is a column that is NULL in rows that are no nodes. A range hands over at most four nodes.
    """
    up, down = Window.partitionBy("__part").orderBy(F.col(x)), Window.partitionBy("__part").orderBy(F.col(x).desc())
    ranked = d.filter(F.col(node).isNotNull()).select("__part", x, node).withColumns({"__u": F.row_number().over(up), "__d": F.row_number().over(down)})
    nodes = ranked.filter("__u <= 2 OR __d <= 2").select("__part", x, F.col(node).alias("__n"))
    marks = d.select("__part").distinct().select("__part", F.lit(None).cast(d.schema[x].dataType).alias(x), F.lit(None).cast(d.schema[node].dataType).alias("__n"))
    few = cut(nodes.unionByName(marks))  # at most five rows a range, so one task orders them
    first, last = Window.orderBy("__part", F.col(x).asc_nulls_first()), Window.orderBy("__part", F.col(x).asc_nulls_last())
    back, ahead = first.rowsBetween(Window.unboundedPreceding, -1), last.rowsBetween(1, Window.unboundedFollowing)
    few = few.withColumns({"__p": F.last("__n", True).over(back), "__f": F.first("__n", True).over(ahead)})
    pair = lambda c: F.when(F.col("__n").isNotNull(), F.struct(F.col("__n").alias("own"), F.col(c).alias("next")))
    few = few.withColumns({"__pp": F.last(pair("__p"), True).over(back), "__ff": F.first(pair("__f"), True).over(ahead)})
    return few.filter(F.col("__n").isNull()).select("__part", F.col("__pp.next").alias("__ca2"), F.col("__pp.own").alias("__ca"), F.col("__ff.own").alias("__cb"), F.col("__ff.next").alias("__cb2"))
