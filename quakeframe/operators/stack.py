"""Azimuth-balanced stacking of single-source slowness into maps.

``events`` has one row per (period_s, cell keys, source): slowness, azimuth, reason, accepted. All operators group by
the cell keys, so one call covers every period and cell. A cell is one group of a task; one of more than ``large`` rows is
dealt to all tasks by ranges of its azimuths (``ranges``), and its weighted sums are partial sums of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..session import cut
from .ranges import LARGE, Attach, aside, by_join, by_window, largest_gaps, running_sum, same, split_large

KEYS = ("period_s", "cell")


def _angle() -> Column:
    return F.pmod(F.col("azimuth"), F.lit(360.0))


def azimuth_peers(events: DataFrame, width: float, keys: tuple[str, ...] = KEYS, large: int = LARGE) -> DataFrame:
    """``events`` with ``peers``: events of the cell, the row itself included, within a circular azimuth distance; 0 without an azimuth.

    Angles within the width of north are repeated a turn away and counted over a range of the sorted angles; no self join.
    """
    if not 0 <= width < 180:
        raise ValueError("the width must be in [0, 180)")
    rest, crowded = split_large(events, keys, large)
    found = _peers_by_window(rest, width, keys)
    return found if crowded is None else found.unionByName(_peers_in_ranges(crowded, width, keys))


def turned(events: DataFrame, width: float) -> DataFrame:
    """``events`` with their angle ``__a``, and those that an interval across north reaches once more a turn away (``__turn``)."""
    reached = lambda t: (t == 0) | (_angle() + t).between(-float(width), 360 + float(width))
    turns = F.filter(F.array(*map(F.lit, (-360.0, 0.0, 360.0))), reached)
    return events.withColumn("__turn", F.explode(turns)).withColumn("__a", _angle() + F.col("__turn"))


def _peers_by_window(events: DataFrame, width: float, keys: tuple[str, ...]) -> DataFrame:
    part = ", ".join(f"`{k}`" for k in keys)
    count = F.expr(f"count(__a) OVER (PARTITION BY {part} ORDER BY __a RANGE BETWEEN {float(width)!r}D PRECEDING AND {float(width)!r}D FOLLOWING)")
    return turned(events, width).withColumn("peers", count).filter("__turn = 0").drop("__turn", "__a")


def _peers_in_ranges(events: DataFrame, width: float, keys: tuple[str, ...]) -> DataFrame:
    """The same counts for crowded cells: running counts of the angles at both ends of each angle's interval, and their difference."""
    marked = events.withColumn("__a", _angle())
    angles = cut(marked.filter("__a IS NOT NULL").groupBy(*keys, "__a").agg(F.count("*").alias("__n")))
    # At equal places an interval's begin comes before the angles and its end behind them.
    angle = [F.struct((F.col("__a") + turn).alias("v"), F.lit(1).alias("kind"), F.col("__n").alias("n")) for turn in (-360.0, 0.0, 360.0)]
    ends = [F.struct((F.col("__a") + step).alias("v"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("n")) for step, kind in ((-float(width), 0), (float(width), 2))]
    # Different angles can share a place after a turn or a step, so places are counted once more.
    places = angles.select(*keys, F.inline(F.array(*angle, *ends))).groupBy(*keys, "v", "kind").agg(F.sum("n").alias("n"))
    upto = cut(running_sum(places, keys, ("v", "kind"), "n", "upto").filter("kind <> 1").select(*keys, "v", "kind", "upto"))
    asked = angles.select(*keys, "__a", F.inline(F.array(F.struct((F.col("__a") - float(width)).alias("v"), F.lit(0).alias("kind")), F.struct((F.col("__a") + float(width)).alias("v"), F.lit(2).alias("kind")))))
    place = (*keys, "v", "kind")
    counted = asked.join(aside(upto, place), same(place)).groupBy(*keys, "__a").agg(F.sum(F.when(F.col("kind") == 2, F.col("upto")).otherwise(-F.col("upto"))).alias("__peers"))
    own = (*keys, "__a")
    found = marked.join(aside(counted, own), same(own), "left")
    return found.select(*events.columns, F.coalesce("__peers", F.lit(0).cast("long")).alias("peers"))


def peer_weights(events: DataFrame, width: float = 20.0, require_peer: bool = True, cap_deviations: float = 3.0, keys: tuple[str, ...] = KEYS, large: int = LARGE) -> DataFrame:
    """``events`` with ``w``: 1 / peers, 0 without a peer if one is required, capped at mean + n standard deviations of the cell's nonzero weights."""
    rest, crowded = split_large(events, keys, large)
    found = _capped(_peers_by_window(rest, width, keys), require_peer, cap_deviations, keys, by_window)
    return found if crowded is None else found.unionByName(_capped(cut(_peers_in_ranges(crowded, width, keys)), require_peer, cap_deviations, keys, by_join))


def _capped(counted: DataFrame, require_peer: bool, cap_deviations: float, keys: tuple[str, ...], attach: Attach) -> DataFrame:
    d = counted.withColumn("w", F.when(F.col("peers") >= (2 if require_peer else 1), 1 / F.col("peers")))
    d = attach(d, keys, {"__mean": F.avg("w"), "__spread": F.stddev_pop("w")})
    cap = F.col("__mean") + cap_deviations * F.col("__spread")
    return d.withColumn("w", F.when(F.col("w").isNull(), 0.0).otherwise(F.least("w", cap))).drop("__mean", "__spread")


def weighted_mean_std(df: DataFrame, value: str = "slowness", weight: str = "w", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, mean, std, n) over rows of positive weight; the variance is corrected by n / (n - 1), NULL for n < 2. Two passes avoid cancellation."""
    used = df.filter((F.col(weight) > 0) & finite(F.col(value)).isNotNull())
    cell = Window.partitionBy(*keys)
    centred = used.withColumn("__m", F.sum(F.col(value) * F.col(weight)).over(cell) / F.sum(weight).over(cell))
    return centred.groupBy(*keys).agg(*_moments(F.col(value), F.col(weight), F.col("__m")))


def _moments(v: Column, w: Column, m: Column) -> tuple[Column, ...]:
    n = F.count("*")
    return F.max(m).alias("mean"), F.when(n > 1, F.sqrt(F.sum(w * (v - m) * (v - m)) / F.sum(w) * n / (n - 1))).alias("std"), n.alias("n")


def normalize(df: DataFrame, keys: tuple[str, ...] = KEYS, weight: str = "w", attach: Attach = by_window) -> DataFrame:
    """Weights that sum to one per cell; cells without weight have 0."""
    d = attach(df, keys, {"__total": F.sum(weight)})
    return d.withColumn(weight, F.when(F.col("__total") > 0, F.col(weight) / F.col("__total")).otherwise(0.0)).drop("__total")


def sigma_clip(df: DataFrame, deviations: float = 3.0, iterations: int = 1, value: str = "slowness", keys: tuple[str, ...] = KEYS, attach: Attach = by_window) -> DataFrame:
    """Weights of rows further than so many deviations from the cell's mean become 0; the rest sum to one again. Each iteration is a stage of the plan."""
    for _ in range(iterations):
        live = F.col("w") > 0
        d = attach(df, keys, {"__sum": F.sum(F.when(live, F.col("w") * F.col(value))), "__sw": F.sum(F.when(live, F.col("w"))), "__n": F.sum(live.cast("long"))})
        gap = F.abs(F.col(value) - F.col("__sum") / F.col("__sw"))
        d = attach(d.withColumn("__g", gap), keys, {"__sg": F.sum(F.when(live, F.col("w") * F.col("__g") * F.col("__g")))})
        std = F.when(F.col("__n") > 1, F.sqrt(F.col("__sg") / F.col("__sw") * F.col("__n") / (F.col("__n") - 1)))
        out = live & (std > 0) & (F.col("__g") > deviations * std)
        clipped = d.withColumn("w", F.when(F.coalesce(out, F.lit(False)), 0.0).otherwise(F.col("w"))).drop("__sum", "__sw", "__n", "__g", "__sg")
        df = normalize(clipped, keys, attach=attach)
    return df


def azimuthal_coverage(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, coverage): 360 less the largest gap between the directions in use; 0 for fewer than two."""
    a = F.pmod(F.col("azimuth"), F.lit(360.0))
    d = df.select(*keys, a.alias("a"))
    gap = F.col("a") - F.lag("a").over(Window.partitionBy(*keys).orderBy("a"))
    found = d.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("n"), F.max("gap").alias("inner"), (F.min("a") + 360 - F.max("a")).alias("around"))
    return found.select(*keys, F.when(F.col("n") < 2, 0.0).otherwise(360 - F.greatest("inner", "around")).alias("coverage"))


def stack_cells(events: DataFrame, width: float = 20.0, min_raw_measurements_per_cell: int = 50, require_peer: bool = True, cap_deviations: float = 3.0, clip_deviations: float | None = 3.0, iterations: int = 1, keys: tuple[str, ...] = KEYS, large: int = LARGE) -> DataFrame:
    """The whole stack: one row per cell with its slowness, velocity, spreads, counts, coverage and mask (true where the map has no value).

    Every window and aggregation has the cell keys, so Spark shuffles the events once. Cells of more than ``large``
    events are counted first and go another way: their events move for the peers alone, and everything else is partial
    sums of the tasks.
    """
    if not 0 <= width < 180:
        raise ValueError("the width must be in [0, 180)")
    valid = events.filter((F.col("reason") == 0) & (finite(F.col("slowness")) > 0) & F.col("accepted"))
    rest, crowded = split_large(valid, keys, large, events)

    def weighted(counted: DataFrame, attach: Attach) -> DataFrame:
        d = attach(_capped(counted, require_peer, cap_deviations, keys, attach), keys, {"raw": F.count("*")})
        d = normalize(d.withColumn("w", F.when(F.col("raw") >= min_raw_measurements_per_cell, F.col("w")).otherwise(0.0)), keys, attach=attach)
        if clip_deviations is not None:
            d = sigma_clip(d, clip_deviations, iterations, "slowness", keys, attach)
        w = F.when(F.col("w") > 0, F.col("w"))
        d = attach(d, keys, {"__sw": F.sum(w), "__ss": F.sum(w * F.col("slowness")), "__sv": F.sum(w / F.col("slowness"))})
        return d.withColumns({"__ms": F.col("__ss") / F.col("__sw"), "__mv": F.col("__sv") / F.col("__sw"), "__a": F.when(F.col("w") > 0, _angle())})

    d = weighted(_peers_by_window(rest, width, keys), by_window)
    d = d.withColumn("__gap", F.col("__a") - F.lag("__a").over(Window.partitionBy(*keys).orderBy(F.col("__a").asc_nulls_first())))
    out = d.groupBy(*keys).agg(*_sums(), F.max("__gap").alias("__gap"), F.min("__a").alias("__lo"), F.max("__a").alias("__hi"))
    if crowded is not None:
        d = cut(weighted(cut(_peers_in_ranges(crowded, width, keys)), by_join))
        gaps = largest_gaps(d, keys, "__a").withColumnsRenamed({"gap": "__gap", "lo": "__lo", "hi": "__hi"})
        sums = d.groupBy(*keys).agg(*_sums())
        out = out.unionByName(sums.join(aside(gaps, keys), same(keys), "left").drop(*[f"__{k}" for k in keys]))
    effective = F.coalesce(1 / F.col("__w2"), F.lit(0.0))
    return out.select(
        *keys,
        "slowness",
        (1 / F.col("slowness")).alias("velocity"),
        "slowness_std",
        F.when(effective > 1, F.col("velocity_std") / F.sqrt(effective)).alias("velocity_sem"),
        effective.alias("effective_count"),
        "raw_count",
        "count",
        F.when(F.col("count") < 2, 0.0).otherwise(360 - F.greatest("__gap", F.col("__lo") + 360 - F.col("__hi"))).alias("coverage"),
        (F.col("slowness").isNull() | (F.col("raw_count") < min_raw_measurements_per_cell)).alias("mask"),
    )


def _sums() -> tuple[Column, ...]:
    """A cell's means and spreads about them, the squares of its weights and its counts."""
    live = F.col("w") > 0
    w, s, v, n = F.when(live, F.col("w")), F.col("slowness"), 1 / F.col("slowness"), F.sum(live.cast("long"))
    fix = F.when(n > 1, n / (n - 1))
    spread = lambda x, m: F.sqrt(F.sum(w * (x - F.col(m)) * (x - F.col(m))) / F.sum(w) * fix)
    return F.max("__ms").alias("slowness"), spread(s, "__ms").alias("slowness_std"), spread(v, "__mv").alias("velocity_std"), F.sum(w * w).alias("__w2"), F.max("raw").alias("raw_count"), n.alias("count")


def eikonal_vs_helmholtz(events: DataFrame, **config: object) -> DataFrame:
    """Both slowness families stacked by one plan: ``events`` also has helmholtz_slowness and helmholtz_reason, and may have helmholtz_accepted, the acceptance of that family; those columns of the result have the prefix ``helmholtz_``."""
    keys = tuple(config.pop("keys", KEYS))  # type: ignore[arg-type]
    other_word = F.col("helmholtz_accepted") if "helmholtz_accepted" in events.columns else F.col("accepted")
    family = lambda name, accepted, slowness, reason: F.struct(F.lit(name).alias("family"), accepted.alias("accepted"), F.col(slowness).alias("slowness"), F.col(reason).alias("reason"))
    # Both families of a row at once, so that the events are read and made once.
    pair = F.array(family("", F.col("accepted"), "slowness", "reason"), family("helmholtz_", other_word, "helmholtz_slowness", "helmholtz_reason"))
    both = stack_cells(events.select(*keys, "source", "azimuth", F.inline(pair)), keys=(*keys, "family"), **config)  # type: ignore[arg-type]
    values = [c for c in both.columns if c not in (*keys, "family")]
    picked = [F.max(F.when(F.col("family") == f, F.col(c))).alias(f"{f}{c}") for f in ("", "helmholtz_") for c in values]
    return both.groupBy(*keys).agg(*picked)


def field_summary(cells: DataFrame, codes: tuple[int, ...] = tuple(range(9))) -> DataFrame:
    """Cells per rejection code for each source and period, and what is counted of the source's measurements where the columns are there."""
    aggs = [F.sum((F.col("reason") == c).cast("long")).alias(f"reason_{c}") for c in codes]
    if "cycles" in cells.columns:
        aggs += [F.sum((F.col("cycles") != 0).cast("long")).alias("n_corrected")]
    if "n_input" in cells.columns:
        aggs += [F.max(c).alias(c) for c in ("n_input", "n_used", "n_amplitude", "n_corrected", "n_rejected", "accepted", "helmholtz_accepted") if c in cells.columns]
    return cells.groupBy("period_s", "source").agg(*aggs)


def run_summary(sources: DataFrame) -> DataFrame:
    """Per period: accepted and all sources."""
    return sources.groupBy("period_s").agg(F.sum(F.col("accepted").cast("long")).alias("n_accepted"), F.count("*").alias("n_sources"))
