"""H-k stacking of receiver functions for all traces and stations at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import amplitude_factor
from ..session import bounded, cut
from . import robust


def search_axis(low: float, high: float, step: float) -> list[float]:
    """int((high - low) / step) + 1 even points from low to high; the step stretches where it does not divide the range."""
    if step <= 0:
        raise ValueError("the step must be positive")
    n = int((high - low) / step) + 1
    if n < 1:
        raise ValueError("the axis is empty")
    return [low + i * (high - low) / (n - 1) for i in range(n)] if n > 1 else [low]


def hk_axes(spark: SparkSession, h: tuple[float, float, float], k: tuple[float, float, float]) -> DataFrame:
    """(h_idx, k_idx, h, k): the search grid, a bounded table."""
    rows = [(i, j, x, y) for i, x in enumerate(search_axis(*h)) for j, y in enumerate(search_axis(*k))]
    return spark.createDataFrame(rows, "h_idx int, k_idx int, h double, k double")


def axes_of(ranges: DataFrame, h_step: float, k_step: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, h_idx, k_idx, h, k): the search grid of every row of ``ranges`` (keys, h0, h1, k0, k1), its axes as of ``search_axis``."""
    d = ranges
    for x, step in (("h", h_step), ("k", k_step)):
        low, width = F.col(f"{x}0"), F.col(f"{x}1") - F.col(f"{x}0")
        d = d.withColumn("last", F.floor(width / step).cast("int")).withColumn(f"{x}_idx", F.explode(F.sequence(F.lit(0), F.col("last"))))
        d = d.withColumn(x, F.when(F.col("last") == 0, low).otherwise(low + F.col(f"{x}_idx") * width / F.col("last"))).drop("last")
    return d.select(*keys, "h_idx", "k_idx", "h", "k")


def stack_lookup(delay: Column, b: Column, delta: Column, n: Column) -> Column:
    """Place of the sample nearest to a delay, the earlier one on ties, held to the trace."""
    return F.greatest(F.lit(0), F.least(n - 1, F.ceil((delay - b) / delta - 0.5))).cast("int")


def hk_surfaces(traces: DataFrame, samples: DataFrame, axes: DataFrame, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), vp: float = 6.3, sediment: tuple[float, float] | None = None, vs: float | None = None) -> DataFrame:
    """(trace_id, station, surface): the grid of each trace as one array of (h_idx, k_idx, h, k, amp).

    Delays are those of one layer, or of a crust below a sediment layer where the trace's row has h0 and k0 (then
    ``sediment`` gives the P velocity of the layer). The samples of a trace and the grid, a bounded table, are arrays of
    one row; each cell reads three samples.
    """
    # A trace costs one lookup a cell, which its bytes do not tell: with a given number, small partitions stay apart.
    dealt = samples.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trace_id")
    arrays = dealt.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a")).select("trace_id", F.transform("a", lambda x: x["v"]).alias("a"))
    cells = axes.agg(F.array_sort(F.collect_list(F.struct("h_idx", "k_idx", "h", "k"))).alias("cells"))
    p = F.col("slowness")
    d = traces.join(arrays, "trace_id").crossJoin(F.broadcast(cells)).withColumn("factor", amplitude_factor(p))
    under = sediment is not None
    if under:
        d = d.withColumns({"qs0": F.sqrt((F.col("k0") / sediment[0]) ** 2 - p * p), "qp0": F.sqrt(F.lit(1 / sediment[0] ** 2) - p * p)})
    n = F.size("a")
    at = lambda delay: F.element_at("a", stack_lookup(delay, F.col("b"), F.col("delta"), n) + 1)

    def slow(c: Column) -> Column:
        v_s = F.lit(vs) if vs is not None else vp / c["k"]
        v_p = vs * c["k"] if vs is not None else F.lit(vp)
        return F.struct(c["h_idx"].alias("h_idx"), c["k_idx"].alias("k_idx"), c["h"].alias("h"), c["k"].alias("k"), F.sqrt(1 / (v_s * v_s) - p * p).alias("qs"), F.sqrt(1 / (v_p * v_p) - p * p).alias("qp"))

    def stacked(c: Column) -> Column:
        qs, qp, h = c["qs"], c["qp"], c["h"]
        delays = [(qs - qp) * h, (qs + qp) * h, 2 * qs * h]
        if under:
            qs0, qp0, h0 = F.col("qs0"), F.col("qp0"), F.col("h0")
            below = [(qs - qp) * (h - h0) + (qs0 - qp0) * h0, (qs + qp) * (h - h0) + (qs0 + qp0) * h0, 2 * qs * (h - h0) + 2 * qs0 * h0]
            delays = [F.when(h0.isNotNull(), two).otherwise(one) for one, two in zip(delays, below, strict=True)]
        ps, ppps, psps = map(at, delays)
        amp = (weights[0] * ps + weights[1] * ppps - weights[2] * psps) * F.col("factor")
        return F.struct(*[c[x].alias(x) for x in ("h_idx", "k_idx", "h", "k")], amp.alias("amp"))

    return d.select("trace_id", "station", F.transform(F.transform("cells", slow), stacked).alias("surface"))


def hk_stack(traces: DataFrame, samples: DataFrame, axes: DataFrame, **config: object) -> DataFrame:
    """(trace_id, station, h_idx, k_idx, h, k, amp): ``hk_surfaces`` with a row a cell."""
    return hk_surfaces(traces, samples, axes, **config).select("trace_id", "station", F.inline("surface"))  # type: ignore[arg-type]


def best_of(surfaces: DataFrame) -> DataFrame:
    """``best_cells`` of surfaces: the largest amplitude of each array, found in its row. A surface without any gives no row."""
    known = F.filter("surface", lambda c: c["amp"].isNotNull())
    ranked = F.transform(known, lambda c: F.struct(c["amp"].alias("energy"), (-c["k_idx"]).alias("nk"), (-c["h_idx"]).alias("nh"), c["h"].alias("h"), c["k"].alias("k")))
    return surfaces.select("trace_id", "station", F.inline(F.array_compact(F.array(F.array_max(ranked))))).select("trace_id", "station", "h", "k", "energy")


def mean_surface(surfaces: DataFrame) -> DataFrame:
    """``mean_hk_surface`` of surfaces: each array is divided by its largest value in its row, and a task sums the traces of a
    station before anything is shuffled, so that what moves is at most one surface a task and station."""
    marked = F.transform(F.array("surface"), lambda s: F.struct(s.alias("cells"), F.array_max(F.transform(s, lambda c: c["amp"])).alias("top")))
    scaled = F.transform(marked, lambda m: F.transform(m["cells"], lambda c: F.struct(c["h_idx"].alias("h_idx"), c["k_idx"].alias("k_idx"), (c["amp"] / F.when(m["top"] == 0, 1.0).otherwise(m["top"])).alias("amp"))))
    return surfaces.select("station", F.inline(F.flatten(scaled))).groupBy("station", "h_idx", "k_idx").agg(F.avg("amp").alias("amp"))


def best_cells(cells: DataFrame, rank: str = "amp") -> DataFrame:
    """(trace_id, station, h, k, energy): the cell with the largest ``rank``, the first by (k, H) on ties, and its unsmoothed energy."""
    best = F.max_by(F.struct("h", "k", F.col("amp").alias("energy")), F.struct(F.col(rank), -F.col("k_idx"), -F.col("h_idx")))
    return cells.filter(F.col(rank).isNotNull()).groupBy("trace_id", "station").agg(best.alias("b")).select("trace_id", "station", "b.*")


def mean_hk_surface(cells: DataFrame) -> DataFrame:
    """(station, h_idx, k_idx, amp): surfaces over their own largest value (1 where that is 0), averaged over the traces of a station."""
    top = F.max("amp").over(Window.partitionBy("trace_id"))
    d = cells.withColumn("amp", F.col("amp") / F.when(top == 0, 1.0).otherwise(top))
    return d.groupBy("station", "h_idx", "k_idx").agg(F.avg("amp").alias("amp"))


def smooth_surface(cells: DataFrame, n_h: int, n_k: int, sigma: float = 1.5, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """``cells`` with ``smooth``: Gaussian smoothing along both axes with reflecting edges and a radius of 4 sigma.

    Each axis is one pass: a cell is offered to the places around it with the kernel's weights, and sums meet per place.
    """
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / sum(raw)).alias("w")) for o, w in zip(range(-radius, radius + 1), raw, strict=True)])
    d = cells.select(*keys, "h_idx", "k_idx", F.col("amp").alias("x"))
    for axis, other, n in (("h_idx", "k_idx", n_h), ("k_idx", "h_idx", n_k)):
        # Place p of the output reads p + o, reflected about the edges; every output place asks for its inputs.
        asked = d.select(*keys, other, F.col(axis).alias("p")).withColumn("e", F.explode(kernel))
        m = F.pmod(F.col("p") + F.col("e.o"), F.lit(2 * n))
        asked = asked.select(*keys, other, "p", F.when(m < n, m).otherwise(2 * n - 1 - m).alias(axis), F.col("e.w").alias("w"))
        d = asked.join(d, [*keys, other, axis]).groupBy(*keys, other, F.col("p").alias(axis)).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return cells.join(d.withColumnRenamed("x", "smooth"), [*keys, "h_idx", "k_idx"])


def hk_sequence(high: DataFrame, low: DataFrame, samples_high: DataFrame, samples_low: DataFrame, axes_sediment: DataFrame, axes_crust: DataFrame, sediment_vp: float = 2.5, crust_vp: float = 6.3, threshold: float = 2.0, least_sediment: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(sediment, crust) summaries per station. The sediment estimate of the high band (only its Mahalanobis mask counts) joins the low-band traces; where it is missing or thin the crust is stacked as one layer."""

    def summary(surfaces: DataFrame) -> DataFrame:
        # One row per trace, read by every pass of the selection.
        chosen = cut(robust.mahalanobis_select(cut(best_of(surfaces)), threshold).filter("kept"))
        return robust.robust_summary(chosen)

    sediment = cut(summary(hk_surfaces(high, samples_high, axes_sediment, vp=sediment_vp)))
    thick = sediment.filter(F.col("h_best") > least_sediment).select("station", F.col("h_best").alias("h0"), F.col("k_best").alias("k0"))
    crust = summary(hk_surfaces(low.join(thick, "station", "left"), samples_low, axes_crust, vp=crust_vp, sediment=(sediment_vp, 0.0)))
    return sediment, crust
