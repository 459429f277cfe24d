"""Contract checks. Each returns violations (rule, key, detail); an empty result means the contract holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, geodesic


def violations(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def assert_contract(*checks: DataFrame) -> None:
    """Raise if any check has a violation; the first ones are named."""
    found = reduce(DataFrame.unionByName, checks).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} ({r['detail']})" for r in found))


def key_of(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def check_unique_paths(paths: DataFrame, keys: tuple[str, ...] = ("component", "source", "receiver", "period_s")) -> DataFrame:
    """Source and receiver differ, and each directed pair occurs once."""
    same = violations(paths.filter("source = receiver"), "self_pair", key_of(*keys), F.lit("source equals receiver"))
    twice = paths.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return same.unionByName(violations(twice, "repeated_path", key_of(*keys), F.col("n")))


def station_roles(paths: DataFrame) -> DataFrame:
    """(station, lon, lat) of both roles of every path."""
    return paths.select(F.col("source").alias("station"), F.col("src_lon").alias("lon"), F.col("src_lat").alias("lat")).union(paths.select("receiver", "rcv_lon", "rcv_lat"))


def check_station_coordinates(paths: DataFrame, tol: float = 1e-6) -> DataFrame:
    """All coordinates given for a station agree within ``tol`` degrees."""
    spread = station_roles(paths).groupBy("station").agg((F.max("lon") - F.min("lon")).alias("dlon"), (F.max("lat") - F.min("lat")).alias("dlat"))
    return violations(spread.filter((F.col("dlon") > tol) | (F.col("dlat") > tol)), "station_moves", F.col("station"), F.greatest("dlon", "dlat"))


def check_ranges(paths: DataFrame, keys: tuple[str, ...] = ("component", "source", "receiver", "period_s")) -> DataFrame:
    """Coordinates are finite and in range, velocities and amplitudes finite and positive, periods positive; one pass over the paths."""
    rules = []
    for role in ("src", "rcv"):
        rules += [(f"{role}_lon_range", finite(F.col(f"{role}_lon")).between(-180, 360)), (f"{role}_lat_range", finite(F.col(f"{role}_lat")).between(-90, 90))]
    rules += [(f"{c}_positive", F.col(c).isNull() | (finite(F.col(c)) > 0)) for c in ("c", "amp")] + [("period_positive", F.col("period_s") > 0)]
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())
    return paths.select(F.explode(failed).alias("rule"), key_of(*keys).alias("key"), F.lit("out of range").alias("detail"))


def check_distances(paths: DataFrame, tol_km: float = 0.5) -> DataFrame:
    """Stored distances agree with the ellipsoid's within ``tol_km``; each pair is computed once."""
    pairs = paths.filter(F.col("distance_km").isNotNull()).select("source", "receiver", "src_lon", "src_lat", "rcv_lon", "rcv_lat", "distance_km").distinct()
    off = pairs.withColumn("gap", F.abs(F.col("distance_km") - geodesic(F.col("src_lon"), F.col("src_lat"), F.col("rcv_lon"), F.col("rcv_lat"))["distance_km"]))
    return violations(off.filter(F.col("gap") > tol_km), "distance", key_of("source", "receiver"), F.round("gap", 3))


def check_segments(segments: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Depth segments start at 0, follow each other without gap or overlap and have a positive thickness."""
    before = F.coalesce(F.lag("bottom").over(Window.partitionBy("model_id").orderBy("seg")), F.lit(0.0))
    d = segments.withColumn("before", before)
    rule = F.when(F.col("bottom") - F.col("top") <= 0, "thickness").when(F.abs(F.col("top") - F.col("before")) > tol, "not_contiguous")
    return d.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", key_of("model_id", "seg").alias("key"), F.col("top").cast("string").alias("detail"))


def check_layers(layers: DataFrame) -> DataFrame:
    """Finite layers have a positive thickness, the last is a half-space of thickness 0; vs, vp, rho are positive and vp > vs."""
    last = F.row_number().over(Window.partitionBy("model_id").orderBy(F.col("layer").desc())) == 1
    rules = {"thickness": F.when(F.col("last"), F.col("thickness") == 0).otherwise(F.col("thickness") > 0), "vs_positive": F.col("vs") > 0, "vp_positive": F.col("vp") > 0, "rho_positive": F.col("rho") > 0, "vp_above_vs": F.col("vp") > F.col("vs")}
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())
    return layers.withColumn("last", last).select(F.explode(failed).alias("rule"), key_of("model_id", "layer").alias("key"), F.lit("layer").alias("detail"))


def check_component_shapes(ccf: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """All required components of a pair are present and equally long. ``ccf`` has one row per sample."""
    sizes = ccf.filter(F.col("component").isin(*required)).groupBy("pair", "component").agg(F.count("*").alias("n"))
    pairs = sizes.groupBy("pair").agg(F.collect_set("component").alias("have"), F.min("n").alias("short"), F.max("n").alias("long"))
    pairs = ccf.select("pair").distinct().join(pairs, "pair", "left").withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.coalesce("have", F.array().cast("array<string>")))))
    absent = violations(pairs.filter(F.size("missing") > 0), "missing_component", F.col("pair"), F.concat_ws(",", "missing"))
    return absent.unionByName(violations(pairs.filter("short <> long"), "unequal_length", F.col("pair"), F.concat_ws("..", F.col("short").cast("string"), F.col("long").cast("string"))))


def missing_rows(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys that are absent."""
    return required.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")


def missing_combinations(present: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Combinations of the distinct ``left`` and ``right`` keys of a table that are absent from it, NULL a key like any other.

    The right keys are few. A left key becomes one row with those it has, and only absent ones become rows, so one row of each
    present combination is shuffled and no required one.
    """
    item = F.struct(*right)
    every = present.select(*right).distinct().agg(F.collect_set(item).alias("every"))
    have = present.groupBy(*left).agg(F.collect_set(item).alias("have"))
    return have.crossJoin(F.broadcast(every)).select(*left, F.inline(F.array_except("every", "have")))
