"""Row filters, reason cascades and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, with_geodesic

# Rejection codes of the two families.
REASONS = {"unstable": 1, "coverage": 2, "velocity": 3, "adjacent": 4, "near_source": 5, "curvature": 6, "boundary": 7, "interpolation": 8}
#: The order in which the rules are tried is not that of the codes.
REASON_ORDER = ("adjacent", "unstable", "coverage", "velocity", "near_source", "curvature", "boundary")
HELMHOLTZ_REASONS = {"not_computed": 1, "eikonal": 2, "unstable": 3, "amplitude": 4, "curvature": 5, "nonpositive": 6}


def valid_measurements(paths: DataFrame, min_snr: float | None = None) -> DataFrame:
    """Paths with a finite positive velocity, marked valid, and a finite SNR of at least ``min_snr`` (in the column's own scale)."""
    keep = (finite(F.col("c")) > 0) & F.coalesce("valid", F.lit(True))
    if min_snr is not None:
        keep &= finite(F.col("snr")) >= min_snr
    return paths.filter(keep)


def first_reason(conditions: dict[str, Column], failed: Column | None = None) -> Column:
    """Code of the first rule that holds, 0 if none; ``failed`` (too few points or no interpolation) comes before all."""
    out = F.when(F.coalesce(failed, F.lit(False)), REASONS["interpolation"]) if failed is not None else F.when(F.lit(False), 0)
    for name in REASON_ORDER:
        if name in conditions:
            out = out.when(F.coalesce(conditions[name], F.lit(False)), REASONS[name])
    return out.otherwise(0).cast("tinyint")


def helmholtz_reason(eikonal: Column, amplitude: Column, correction: Column, slowness: Column, reference_velocity: float, unstable: Column | None = None, computed: Column | None = None, adjacent: Column | None = None, min_amplitude: float = 0.0) -> Column:
    """Code of the amplitude family: not computed, eikonal rejected, bad amplitude, unstable, too curved, no real slowness, or 0.

    A bad amplitude is missing, not above ``min_amplitude``, or beside a missing one (``adjacent``); a missing correction
    is too curved.
    """
    s2 = slowness * slowness - correction
    out = F.when(~F.coalesce(computed, F.lit(False)), 1) if computed is not None else F.when(F.lit(False), 1)
    bad = F.coalesce(finite(amplitude) <= min_amplitude, F.lit(True))
    if adjacent is not None:
        bad = bad | F.coalesce(adjacent, F.lit(False))
    out = out.when(eikonal != 0, 2).when(bad, 4)
    if unstable is not None:
        out = out.when(unstable, 3)
    return out.when(F.coalesce(F.abs(finite(correction)) > 1 / reference_velocity**2, F.lit(True)), 5).when(F.coalesce(s2 <= 0, F.lit(True)), 6).otherwise(0).cast("tinyint")


def near_source(cells: DataFrame, reference_velocity: float = 3.0, wavelengths: float = 1.0) -> DataFrame:
    """Cells with ``near``: closer to the source than so many wavelengths. Needs lon, lat, src_lon, src_lat, period_s."""
    d = with_geodesic(cells, "src_lon", "src_lat", "lon", "lat", "__g")
    return d.withColumn("near", F.col("__g.distance_km") < wavelengths * reference_velocity * F.col("period_s")).drop("__g")


def boundary_cells(cells: DataFrame, n_lat: int, n_lon: int, n: int) -> DataFrame:
    """Cells with ``boundary``: in the outer n rows or columns; n is held to half the smaller side."""
    n = max(0, min(n, (min(n_lat, n_lon) + 1) // 2))
    i, j = F.col("i_lat"), F.col("i_lon")
    return cells.withColumn("boundary", (i < n) | (i >= n_lat - n) | (j < n) | (j >= n_lon - n))


def snr_select(df: DataFrame, threshold: float, reverse: bool = False) -> DataFrame:
    keep = F.coalesce(F.col("snr") >= threshold, F.lit(False))
    return df.filter(~keep if reverse else keep)


def slowness_select(df: DataFrame, low: float, high: float, reverse: bool = False) -> DataFrame:
    keep = F.coalesce(F.col("slowness").between(low, high), F.lit(False))
    return df.filter(~keep if reverse else keep)


def source_acceptance(cells: DataFrame, grid_cells: int, min_cells: int = 1, min_fraction: float = 0.0, reason: str = "reason", out: str = "accepted") -> DataFrame:
    """Accepted sources per period: valid cells are at least ``min_cells`` and the given part of the whole grid."""
    counts = cells.groupBy("period_s", "source").agg(F.sum((F.col(reason) == 0).cast("long")).alias("n_valid"))
    return counts.withColumn(out, (F.col("n_valid") > 0) & (F.col("n_valid") >= min_cells) & (F.col("n_valid") / grid_cells >= min_fraction))
