"""Dispersion curves: interpolation, phase cycles, branches and quality, for all curves at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut
from .ranges import border_nodes, in_ranges

#: Nodes of a curve without keys up to which it is broadcast as one row.
NODES = 1 << 10


def interpolate_at(curve: DataFrame, queries: DataFrame, x: str = "period", y: str = "velocity", keys: tuple[str, ...] = (), extrapolate: str = "linear", out: str = "reference", nodes_at_once: int = NODES) -> DataFrame:
    """``queries`` with the piecewise-linear value of the curve at their ``x``.

    Nodes and queries meet in one sort per key: windows carry the nodes before and after each query (a bracketing
    join without comparing all pairs). Beyond the ends: ``linear`` continues the outer segment, ``clamp`` holds the end
    value, ``null`` gives NULL. A curve that is shared by all queries has no keys: up to NODES nodes it is one broadcast
    row, beyond that nodes and queries meet in ranges of ``x``, and each range knows the nodes at its borders.
    """
    if not keys:
        known = curve.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
        if known.limit(nodes_at_once + 1).count() > nodes_at_once:
            return _bracketed(known, queries, x, y, (), extrapolate, out)
        # A short curve is a list of nodes; each query finds its segment in the array.
        nodes = known.agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("__n"))
        d = queries.crossJoin(F.broadcast(nodes))
        n = F.size("__n")
        below = F.size(F.filter("__n", lambda p: p["x"] <= F.col(x)))
        at = F.greatest(F.lit(1), F.least(n - 1, below))
        a, b = F.get("__n", at - 1), F.get("__n", at)
        line = a["y"] + (F.col(x) - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
        first, last = F.get("__n", F.lit(0)), F.get("__n", n - 1)
        value = {"linear": line, "clamp": F.when(F.col(x) < first["x"], first["y"]).when(F.col(x) > last["x"], last["y"]).otherwise(line), "null": F.when(F.col(x).between(first["x"], last["x"]), line)}[extrapolate]
        return d.withColumn(out, value).drop("__n")
    return _bracketed(curve, queries, x, y, keys, extrapolate, out)


def _bracketed(curve: DataFrame, queries: DataFrame, x: str, y: str, keys: tuple[str, ...], extrapolate: str, out: str) -> DataFrame:
    """Nodes and queries in one order; windows of a key, or of a range of ``x`` where there are no keys."""
    cols = queries.columns
    q = queries.withColumn("__q", F.lit(1))
    nodes = curve.select(*keys, x, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("__p"))
    d = q.unionByName(nodes.withColumn("__q", F.lit(0)), allowMissingColumns=True)
    border = lambda name, own: own if keys else F.coalesce(own, F.col(name))
    if not keys:
        d = in_ranges(d, (x, "__q"))
        d = d.join(bounded(cut(border_nodes(d, x, "__p"))), "__part")
    w = Window.partitionBy(*(keys or ("__part",))).orderBy(F.col(x), "__q")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({"__a": border("__ca", F.last("__p", True).over(back)), "__b": border("__cb", F.first("__p", True).over(ahead))})
    # The second node on each side, for queries beyond an end.
    d = d.withColumn("__pa", F.when(F.col("__q") == 0, border("__ca", F.lag("__a").over(w)))).withColumn("__nb", F.when(F.col("__q") == 0, border("__cb", F.lead("__b").over(w))))
    d = d.withColumns({"__a2": border("__ca2", F.last("__pa", True).over(back)), "__b2": border("__cb2", F.first("__nb", True).over(ahead))})
    a, b, a2, b2 = (F.col(c) for c in ("__a", "__b", "__a2", "__b2"))
    seg = lambda p, r: p["y"] + (F.col(x) - p["x"]) * (r["y"] - p["y"]) / (r["x"] - p["x"])
    inner = F.when(a["x"] == F.col(x), a["y"]).when(a.isNotNull() & b.isNotNull(), seg(a, b))
    low = {"linear": seg(b, b2), "clamp": b["y"], "null": F.lit(None)}[extrapolate]
    high = {"linear": seg(a2, a), "clamp": a["y"], "null": F.lit(None)}[extrapolate]
    d = d.withColumn(out, F.when(F.col(x).isNull(), None).when(a.isNotNull() & b.isNotNull(), inner).when(a.isNull(), low).otherwise(F.coalesce(F.when(a["x"] == F.col(x), a["y"]), high)))
    return d.filter("__q = 1").select(*cols, out)


def curvature_log_period(curves: DataFrame, value: str = "velocity") -> DataFrame:
    """``curves`` with the second divided difference against ln(period); 0 at both ends."""
    w = Window.partitionBy("curve").orderBy("period")
    x, y = F.log("period"), F.col(value)
    d = curves.withColumns({"__x": x, "__x0": F.lag(F.log("period")).over(w), "__x1": F.lead(F.log("period")).over(w), "__y0": F.lag(value).over(w), "__y1": F.lead(value).over(w)})
    c = ((F.col("__y1") - y) / (F.col("__x1") - F.col("__x")) - (y - F.col("__y0")) / (F.col("__x") - F.col("__x0"))) / (F.col("__x1") - F.col("__x0"))
    return d.withColumn("curvature", F.coalesce(c, F.lit(0.0))).drop("__x", "__x0", "__x1", "__y0", "__y1")


def longest_branch(curves: DataFrame, threshold: float) -> DataFrame:
    """Rows of the longest run between curvature triggers and ends, borders included, the first on ties; all rows of a curve without trigger."""
    w = Window.partitionBy("curve").orderBy("period")
    d = curvature_log_period(curves).withColumn("__i", F.row_number().over(w) - 1)
    n = F.max("__i").over(Window.partitionBy("curve"))
    breaks = d.withColumn("__n", n).filter((F.abs("curvature") > threshold) | (F.col("__i") == 0) | (F.col("__i") == F.col("__n"))).select("curve", "__i")
    b = breaks.withColumn("__j", F.lead("__i").over(Window.partitionBy("curve").orderBy("__i")))
    best = b.groupBy("curve").agg(F.max_by(F.struct("__i", F.coalesce("__j", "__i").alias("__j")), F.struct(F.coalesce(F.col("__j") - F.col("__i"), F.lit(0)), -F.col("__i"))).alias("s"))
    return d.join(best, "curve").filter(F.col("__i").between(F.col("s.__i"), F.col("s.__j"))).drop("__i", "s")


def unwrap_phase(picks: DataFrame, reference: DataFrame, order: str = "period") -> DataFrame:
    """(curve, period, phase_velocity) from rows (curve, period, group_velocity, phase, distance), and ``order`` if that is another column.

    From the last period of ``order`` down the wavenumber is integrated by trapezoids of the group slowness and the phase takes
    the nearest cycle; the first cycle comes from the reference velocity. One ordered fold per curve, in the JVM.
    """
    two_pi = 2 * math.pi
    own = () if order == "period" else (order,)
    longest = picks.groupBy("curve").agg(F.max_by("period", order).alias("period"))
    first = interpolate_at(reference, longest, out="c0").select("curve", "c0")
    d = picks.join(first, "curve").groupBy("curve").agg(F.sort_array(F.collect_list(F.struct(*own, "period", "group_velocity", "phase", "distance", "c0")), False).alias("a"))

    def step(state: Column, p: Column) -> Column:
        omega, time, slow = two_pi / p["period"], p["distance"] / p["group_velocity"], 1 / p["group_velocity"]
        start = omega * time - omega / p["c0"] * p["distance"]
        k0 = F.rint((start - p["phase"]) / two_pi)
        c_first = omega * p["distance"] / (omega * time - (p["phase"] + k0 * two_pi))
        k = state["omega"] / state["c"] + (omega - state["omega"]) * (slow + state["slow"]) / 2
        predicted = omega * time - k * p["distance"]
        n = F.rint((p["phase"] - predicted) / two_pi)
        c_next = omega * p["distance"] / (omega * time - p["phase"] + n * two_pi)
        c = F.when(state["c"].isNull(), c_first).otherwise(c_next)
        return F.struct(omega.alias("omega"), slow.alias("slow"), c.alias("c"), F.concat(state["out"], F.array(F.struct(*[p[x].alias(x) for x in (*own, "period")], c.alias("phase_velocity")))).alias("out"))

    kinds = ",".join(f"{x}:{picks.schema[x].dataType.simpleString()}" for x in (*own, "period"))
    zero = F.struct(F.lit(None).cast("double").alias("omega"), F.lit(None).cast("double").alias("slow"), F.lit(None).cast("double").alias("c"), F.array().cast(f"array<struct<{kinds},phase_velocity:double>>").alias("out"))
    return d.select("curve", F.aggregate("a", zero, step, lambda s: s["out"]).alias("o")).select("curve", F.inline("o"))


def select_cycle_shift(curves: DataFrame, max_shift: int = 3, max_score: float = 0.25, min_gap: float = 0.1, enabled: bool = True) -> DataFrame:
    """One row per curve: the global integer shift whose median absolute residual against ``reference`` is smallest.

    Rows are (curve, period, velocity, reference, distance). All shifted slownesses must stay positive; ties go to
    the smaller absolute shift, then the smaller shift. Also the score, its gap to the runner-up, the rms misfit before
    and after, the number of valid periods, and a status.
    """
    good = (F.col("period") > 0) & (F.col("velocity") > 0) & (F.col("reference") > 0)
    d = curves.filter(good).withColumn("res", (F.col("distance") / F.col("velocity") - F.col("distance") / F.col("reference")) / F.col("period"))
    steps = F.sequence(F.lit(-max_shift), F.lit(max_shift)) if enabled else F.array(F.lit(0))
    e = d.withColumn("s", F.explode(steps)).withColumn("slow", 1 / F.col("velocity") + F.col("s") * F.col("period") / F.col("distance"))
    scored = e.groupBy("curve", "s").agg(F.median(F.abs(F.col("res") + F.col("s"))).alias("score"), F.min("slow").alias("least"), F.sqrt(F.avg((1 / F.col("slow") - F.col("reference")) ** 2)).alias("rmse"), F.count("*").alias("n"))
    best = top_candidate_with_gap(scored.filter("least > 0"), ["curve"], ["score", F.abs("s"), F.col("s")], "score", ("s", "rmse", "n"))
    before = d.groupBy("curve").agg(F.sqrt(F.avg((F.col("velocity") - F.col("reference")) ** 2)).alias("rmse_before"), F.count("*").alias("n_valid"))
    out = curves.select("curve").distinct().join(before, "curve", "left").join(best, "curve", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    out = out.withColumn("shift", F.coalesce("s", F.lit(0)))
    limit = (F.abs("shift") == max_shift) & F.lit(enabled and max_shift > 0)
    score_ok = F.coalesce(F.col("score") <= max_score, F.lit(False))
    gap_ok = F.coalesce(F.col("gap") >= min_gap, F.lit(False)) | F.lit(not enabled or max_shift == 0)
    status = F.when(F.lit(not enabled), "disabled").when(F.col("n_valid") < 2, "insufficient_reference").when(limit, "search_limit_reached").when(~score_ok, "reference_misfit").when(~gap_ok, "ambiguous").when(F.col("shift") != 0, "corrected").otherwise("unchanged")
    return out.select("curve", "shift", "score", "gap", "rmse_before", F.col("rmse").alias("rmse_after"), "n_valid", status.alias("status"))


def top_candidate_with_gap(df: DataFrame, keys: list[str], order: list, score: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best row per group with its score, the columns ``keep``, and the gap to the runner-up's score (NULL without one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__r", F.row_number().over(w)).filter("__r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("__r") == r, F.col(c)))
    return d.groupBy(*keys).agg(*[pick(c, 1).alias(c) for c in keep], pick(score, 1).alias(score), (pick(score, 2) - pick(score, 1)).alias("gap"))


def strided_top_k(df: DataFrame, keys: list[str], order: list, stride: int, k: int) -> DataFrame:
    """Every stride-th row of the ordered group, the first k of them, at least one."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__r", r).filter((F.col("__r") % stride == 0) & (F.col("__r") < stride * max(k, 1))).drop("__r")


def sort_curve(curves: DataFrame) -> DataFrame:
    """Rows of a curve together and by ascending period; no global order."""
    return curves.repartition("curve").sortWithinPartitions("curve", "period")


def branch_qc(curves: DataFrame, period_rel_warning: float = 0.3, min_valid_fraction: float = 0.5) -> DataFrame:
    """Quality of each branch from rows (curve, target_period, instant_period, velocity, amplitude, initial_count)."""
    ok = F.col("target_period").isNotNull() & F.col("instant_period").isNotNull() & (F.col("target_period") > 0)
    gap = F.when(ok, F.abs(F.col("instant_period") - F.col("target_period")))
    out = curves.groupBy("curve").agg(
        F.max("initial_count").alias("initial_count"),
        F.count("*").alias("retained_count"),
        F.sum(ok.cast("long")).alias("valid_points"),
        F.median(gap).alias("period_abs_median"),
        F.median(gap / F.col("target_period")).alias("period_rel_median"),
        F.max(gap / F.col("target_period")).alias("period_rel_max"),
        F.min("velocity").alias("velocity_min"),
        F.max("velocity").alias("velocity_max"),
        F.max("amplitude").alias("amplitude_max"),
    )
    fraction = F.when(F.col("initial_count") > 0, F.col("retained_count") / F.col("initial_count")).otherwise(0.0)
    return out.withColumns({"retained_fraction": fraction, "warn_period": F.coalesce(F.col("period_rel_max") > period_rel_warning, F.lit(False)), "warn_short": (fraction < min_valid_fraction) & F.lit(min_valid_fraction > 0)})


def energy_map(bank: DataFrame, distance: DataFrame, velocities: tuple[float, float, float]) -> DataFrame:
    """(trace_id, period, velocity, amplitude) from rows (trace_id, period, i, t, envelope), uniformly sampled.

    The envelope is read at distance / velocity by linear interpolation: each cell asks for two neighbouring samples by
    place, an equality join. NULL outside the trace; each period is divided by its largest value (1 where that is 0).
    """
    axis = bank.sparkSession.range(round((velocities[1] - velocities[0]) / velocities[2]) + 1).select((F.lit(velocities[0]) + F.col("id") * velocities[2]).alias("velocity"))
    ends = bank.groupBy("trace_id", "period").agg(F.min("t").alias("b"), ((F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("dt"), F.min("i").alias("i0"))
    cells = ends.join(distance.select("trace_id", "distance"), "trace_id").crossJoin(F.broadcast(axis))
    place = (F.col("distance") / F.col("velocity") - F.col("b")) / F.col("dt")
    cells = cells.withColumn("x", place).withColumn("i", (F.floor("x") + F.col("i0")).cast("int")).withColumn("f", F.col("x") - F.floor("x"))
    w = Window.partitionBy("trace_id", "period").orderBy("i")
    pairs = bank.select("trace_id", "period", "i", "envelope", F.lead("envelope").over(w).alias("after"))
    d = cells.join(pairs, ["trace_id", "period", "i"], "left")
    value = F.when(F.col("f") == 0, F.col("envelope")).otherwise(F.col("envelope") + F.col("f") * (F.col("after") - F.col("envelope")))
    d = d.select("trace_id", "period", "velocity", value.alias("amplitude"))
    top = F.max("amplitude").over(Window.partitionBy("trace_id", "period"))
    return d.withColumn("amplitude", F.col("amplitude") / F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise(top))


def phase_candidates(picks: DataFrame, n_cycles: int, velocities: tuple[float, float, float], normalise: bool = True) -> DataFrame:
    """(curve, period, velocity, amplitude): every pick's aliases of up to n cycles inside the velocity range, each spread with a Gaussian of 1.5 velocity steps. Rows are (curve, period, phase_velocity, amplitude, distance)."""
    low, high, dv = velocities
    axis = picks.sparkSession.range(round((high - low) / dv) + 1).select((F.lit(low) + F.col("id") * dv).alias("velocity"))
    c = F.col("distance") / (F.col("distance") / F.col("phase_velocity") + F.col("n") * F.col("period"))
    alias = picks.withColumn("n", F.explode(F.sequence(F.lit(-n_cycles), F.lit(n_cycles)))).withColumn("c", c).filter(F.col("c").between(low, high))
    g = F.exp(-0.5 * ((F.col("velocity") - F.col("c")) / (1.5 * dv)) ** 2)
    d = alias.crossJoin(F.broadcast(axis)).groupBy("curve", "period", "velocity").agg(F.sum(F.col("amplitude") * g).alias("amplitude"))
    if not normalise:
        return d
    top = F.max("amplitude").over(Window.partitionBy("curve", "period"))
    return d.withColumn("amplitude", F.col("amplitude") / F.when(top == 0, 1.0).otherwise(top))


def period_grid(df: DataFrame, mode: str, min_period: float, max_period: str = "max_period", count: int | None = None, step: float | None = None, dfreq: float = 0.1, min_count: int = 3, periods: tuple[float, ...] = ()) -> DataFrame:
    """``df`` with a row per target period; the longest one is a column since it depends on the distance.

    ``list`` keeps distinct periods in range, ``geomspace`` spaces them by a factor, ``uniform`` by a step (the last
    point is appended) or a count. Rows whose range is empty give none.
    """
    high = F.col(max_period)
    if mode == "list":
        out = F.filter(F.array(*map(F.lit, sorted(set(periods)))), lambda p: (p >= min_period) & (p <= high))
    else:
        n = F.lit(count) if count is not None else F.greatest(F.lit(min_count), F.floor(F.log(high / min_period) / dfreq).cast("int"))
        place = F.sequence(F.lit(0), n - 1)
        if mode == "geomspace":
            out = F.transform(place, lambda i: min_period * F.pow(high / min_period, i / (n - 1)))
        elif step is not None:
            inner = F.transform(F.sequence(F.lit(0), F.floor((high - min_period) / step + 1e-9).cast("int")), lambda i: min_period + i * step)
            out = F.when(F.element_at(inner, -1) < high, F.concat(inner, F.array(high))).otherwise(inner)
        else:
            out = F.transform(place, lambda i: min_period + i * (high - min_period) / (n - 1))
    return df.filter(high > min_period).withColumn("target_period", F.explode(out))
