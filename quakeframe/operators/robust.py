"""Robust selection and summaries of point sets, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def dedupe_median(points: DataFrame, keys: tuple[str, ...], x: str = "x", y: str = "y", value: str = "value", ndigits: int = 8, least: int = 3) -> DataFrame:
    """Points of equal rounded coordinates become one with the median value; groups with fewer than ``least`` points are dropped.

    Coordinates are rounded only in groups where something was repeated.
    """
    group = Window.partitionBy(*keys)
    d = points.withColumns({"__x": F.round(x, ndigits), "__y": F.round(y, ndigits)})
    merged = d.groupBy(*keys, "__x", "__y").agg(F.median(value).alias(value), F.count("*").alias("__n"), F.first(x).alias(x), F.first(y).alias(y))
    merged = merged.withColumns({"__twice": F.max("__n").over(group) > 1, "__points": F.count("*").over(group)}).filter(F.col("__points") >= least)
    return merged.select(*keys, F.when(F.col("__twice"), F.col("__x")).otherwise(F.col(x)).alias(x), F.when(F.col("__twice"), F.col("__y")).otherwise(F.col(y)).alias(y), value)


def block_median(points: DataFrame, keys: tuple[str, ...], x0: float, y0: float, spacing: float, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """One point per grid block, the medians of its coordinates and values."""
    block = lambda c, o: F.floor((F.col(c) - o) / spacing + 0.5)
    return points.groupBy(*keys, block(x, x0).alias("bx"), block(y, y0).alias("by")).agg(*[F.median(c).alias(c) for c in (x, y, value)])


def _mad(df: DataFrame, key: str, columns: tuple[str, ...], floor: float, scale: float = MAD_SCALE) -> DataFrame:
    """``df`` with <c>_med and <c>_mad per group; two grouped passes joined back."""
    med = df.groupBy(key).agg(*[F.median(c).alias(f"{c}_med") for c in columns])
    d = df.join(med, key)
    mad = d.groupBy(key).agg(*[F.median(F.abs(F.col(c) - F.col(f"{c}_med"))).alias(f"{c}_mad") for c in columns])
    held = [F.when(F.col(f"{c}_mad") * scale > floor, F.col(f"{c}_mad") * scale).otherwise(floor).alias(f"{c}_mad") for c in columns]
    return d.join(mad.select(key, *held), key)


def mad_outliers(samples: DataFrame, threshold: float = 2.5, window: tuple[float, float] = (-5.0, 30.0), key: str = "station") -> DataFrame:
    """Traces with the robust score of their variance in the window against their station; ``kept`` up to the threshold."""
    var = samples.filter(F.col("t").between(*window)).groupBy(key, "trace_id").agg(F.var_pop("v").alias("var"))
    d = _mad(var, key, ("var",), 0.0)
    score = F.abs(F.col("var") - F.col("var_med")) / F.when(F.col("var_mad") > 0, F.col("var_mad")).otherwise(1e-12)
    return d.select(key, "trace_id", score.alias("score"), (score <= threshold).alias("kept"))


def elliptical_mad(df: DataFrame, x: str = "h", y: str = "k", sigma: float = 2.0, key: str = "station") -> DataFrame:
    """``df`` with ``kept``: the sum of squared robust scores is below sigma squared."""
    d = _mad(df, key, (x, y), 1e-6)
    score = sum(((F.col(c) - F.col(f"{c}_med")) / F.col(f"{c}_mad")) ** 2 for c in (x, y))
    return d.withColumn("kept", score < sigma**2).drop(*[f"{c}_{s}" for c in (x, y) for s in ("med", "mad")])


def mahalanobis_select(df: DataFrame, threshold: float = 2.0, x: str = "h", y: str = "k", weight: str = "energy", key: str = "station") -> DataFrame:
    """``df`` with ``kept``: the energy-weighted Mahalanobis distance is below the threshold; a group of one is kept.

    The 2 x 2 covariance is inverted in closed form; a covariance of rank one or zero uses its pseudo-inverse.
    """
    total = df.groupBy(key).agg(F.sum(weight).alias("__e"), F.count("*").alias("__n"))
    d = df.join(total, key).withColumn("__w", F.when(F.col("__e") > 0, F.col(weight)).otherwise(1.0))
    mean = d.groupBy(key).agg(F.sum("__w").alias("__t"), *[(F.sum(F.col("__w") * F.col(c)) / F.sum("__w")).alias(f"__m{c}") for c in (x, y)])
    d = d.join(mean, key).withColumns({"__dx": F.col(x) - F.col(f"__m{x}"), "__dy": F.col(y) - F.col(f"__m{y}")})
    w = F.col("__w")
    cov = d.groupBy(key).agg(*[(F.sum(w * F.col(a) * F.col(b)) / F.sum(w)).alias(n) for n, a, b in (("__a", "__dx", "__dx"), ("__b", "__dx", "__dy"), ("__c", "__dy", "__dy"))])
    d = d.join(cov, key)
    a, b, c, p, q = (F.col(n) for n in ("__a", "__b", "__c", "__dx", "__dy"))
    det, trace = a * c - b * b, a + c
    # Of a rank-one matrix M the pseudo-inverse is M / trace(M)^2.
    full = (c * p * p - 2 * b * p * q + a * q * q) / det
    thin = (a * p * p + 2 * b * p * q + c * q * q) / (trace * trace)
    square = F.when(trace == 0, 0.0).when(det <= 1e-15 * trace * trace, thin).otherwise(full)
    kept = (F.col("__n") < 2) | (F.sqrt(F.greatest(F.lit(0.0), square)) < threshold)
    return d.withColumn("kept", kept).select(*df.columns, "kept")


def energy_select(df: DataFrame, threshold: float = 0.5, energy: str = "energy", key: str = "station") -> DataFrame:
    """``df`` with ``kept``: energy of at least a part of the group's largest."""
    top = df.groupBy(key).agg(F.max(energy).alias("__top"))
    return df.join(top, key).withColumn("kept", F.col(energy) >= threshold * F.col("__top")).drop("__top")


def robust_summary(df: DataFrame, columns: tuple[str, ...] = ("h", "k"), small: int = 15, key: str = "station") -> DataFrame:
    """(key, n, <c>_best, <c>_uncert): mean and population deviation of small groups, else median and unscaled MAD."""
    first = df.groupBy(key).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("med", F.median))])
    d = df.join(first.select(key, *[f"{c}_med" for c in columns]), key)
    mad = d.groupBy(key).agg(*[F.median(F.abs(F.col(c) - F.col(f"{c}_med"))).alias(f"{c}_mad") for c in columns])
    few = F.col("n") < small
    pick: list[Column] = []
    for c in columns:
        pick += [F.when(few, F.col(f"{c}_mean")).otherwise(F.col(f"{c}_med")).alias(f"{c}_best"), F.when(few, F.col(f"{c}_std")).otherwise(F.col(f"{c}_mad")).alias(f"{c}_uncert")]
    return first.join(mad, key).select(key, "n", *pick)
