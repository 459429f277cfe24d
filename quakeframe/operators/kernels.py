"""Spectral and sequential steps inside one trace, curve or source, as Arrow kernels that Spark groups and distributes.

A kernel sees one bounded group: the samples of a trace, the periods of a curve, or the receivers of one source.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_KM, wrap180
from ..session import cut, settle
from . import fields as A
from . import masks as M

TAU = 2 * math.pi


def analytic_spectrum(data: np.ndarray, n: int) -> np.ndarray:
    """Spectrum whose negative frequencies are zero, so that its inverse is the analytic signal."""
    s = np.fft.fft(data, n)
    s[1 : (n + 1) // 2] *= 2
    s[n // 2 + 1 :] = 0
    return s


def narrow_bands(data: np.ndarray, dt: float, periods: np.ndarray, alpha: float, part: float = 0.05) -> np.ndarray:
    """Complex narrow-band traces (periods, samples): ends tapered, padded to a power of two, Gaussian filters around each period."""
    n = len(data)
    edge = max(1, int(part * n))
    ramp = 0.5 * (1 - np.cos(np.pi * np.arange(edge) / edge))
    tapered = data.astype(float).copy()
    tapered[:edge] *= ramp
    tapered[n - edge :] *= ramp[::-1]
    size = 1 << (n - 1).bit_length()
    omega = TAU * np.fft.fftfreq(size, dt)
    centre = TAU / np.asarray(periods)[:, None]
    power = -alpha * ((omega - centre) / centre) ** 2
    return np.fft.ifft(analytic_spectrum(tapered, size) * np.where(power < -40, 0, np.exp(np.maximum(power, -40))), axis=1)[:, :n]


def sample_arrays(samples: DataFrame) -> DataFrame:
    """(trace_id, b, dt, a): the samples of each trace in order, as one row."""
    return samples.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"), F.min("t").alias("b"), ((F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("dt")).select("trace_id", "b", "dt", F.transform("s", lambda x: x["v"]).alias("a"))


BANK = "b double, dt double, envelope array<double>, phase array<double>"


def ftan_arrays(samples: DataFrame, periods: tuple[float, ...] | None = None, alpha: float = 20.0, traces: DataFrame | None = None) -> DataFrame:
    """(trace_id, columns of ``traces``, period, b, dt, envelope, phase): one row for each trace and target period, its samples in arrays.

    ``traces`` has one row a trace with what later steps need of it (a distance); a column ``periods`` of it holds the
    trace's own target periods, used without ``periods``. Traces that are not in it give no rows. It meets the samples
    where these are put together, so nothing is shuffled after the filters.
    """
    rows = sample_arrays(samples)
    if traces is not None:
        rows = rows.join(traces, "trace_id")
    kept = [c for c in rows.columns if c not in ("trace_id", "b", "dt", "a", "periods")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in ("trace_id", *kept)), "period double", BANK])
    if periods is not None:
        rows = rows.drop("periods").withColumn("periods", F.array(*map(F.lit, periods)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                target = np.asarray(r["periods"], float)
                z = narrow_bands(np.asarray(r["a"]), r["dt"], target, alpha)
                yield pd.DataFrame({"trace_id": r["trace_id"], **{c: r[c] for c in kept}, "period": target, "b": r["b"], "dt": r["dt"], "envelope": list(np.abs(z)), "phase": list(np.angle(z))})

    return rows.select("trace_id", "b", "dt", "a", "periods", *kept).mapInPandas(run, ddl)


def bank_rows(bank: DataFrame) -> DataFrame:
    """(trace_id, period, i, t, envelope, phase) of a bank in arrays."""
    d = bank.select("trace_id", "period", "b", "dt", F.posexplode(F.arrays_zip("envelope", "phase")).alias("i", "z"))
    return d.select("trace_id", "period", "i", (F.col("b") + F.col("i") * F.col("dt")).alias("t"), "z.envelope", "z.phase")


def ftan(samples: DataFrame, periods: tuple[float, ...], alpha: float = 20.0) -> DataFrame:
    """(trace_id, period, i, t, envelope, phase) of every trace and target period, a row for each sample."""
    return bank_rows(ftan_arrays(samples, periods, alpha))


def _spline_integral(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Integral of the not-a-knot cubic spline through (x, y) from x[0] to each point of ``at``; lines and parabolas for two and three points."""
    n = len(x)
    if n < 4:
        c = np.polyint(np.polyfit(x, y, n - 1))
        return np.polyval(c, at) - np.polyval(c, x[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1], m[i, i], m[i, i + 1] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        r[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    for row, (a, b, p, q) in ((0, (h[0], h[1], 0, 1)), (n - 1, (h[-1], h[-2], n - 1, n - 2))):
        m[row, p], m[row, q] = b, a + b
        first, second = (d[0], d[1]) if row == 0 else (d[-1], d[-2])
        r[row] = ((a + 2 * (a + b)) * b * first + a * a * second) / (a + b)
    s = np.linalg.solve(m, r)
    c2, c3 = (3 * d - 2 * s[:-1] - s[1:]) / h, (s[:-1] + s[1:] - 2 * d) / h**2
    part = lambda k, u: u * (y[k] + u * (s[k] / 2 + u * (c2[k] / 3 + u * c3[k] / 4)))
    whole = np.concatenate([[0], np.cumsum(part(np.arange(n - 1), h))])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    return whole[k] + part(k, at - x[k])


def _skirt(env: np.ndarray, minima: np.ndarray, peak: int, dt: float, half: float, ratio: float, end: int) -> tuple[int, int] | None:
    """Steps from the peak to the nearest minimum that is far and quiet enough, and to the next such one (or the end)."""
    good = [abs(int(m) - peak) for m in minima if env[m] < ratio * env[peak] and abs(int(m) - peak) * dt > half]
    return (good[0], good[1] if len(good) > 1 else abs(end - peak)) if good else None


def pulse_window(env: np.ndarray, dt: float, half: float, ratio: float, factor: float) -> np.ndarray:
    """One between two envelope minima around the largest value, Gaussian skirts beyond them.

    With a minimum on both sides the window is even: the wider half and the wider skirt hold for both. A skirt's width
    is the way from its minimum to the next one, plus one sample; ``factor`` stretches both about the peak.
    """
    n, peak = len(env), int(np.argmax(env))
    low = np.nonzero((env[1:-1] < env[:-2]) & (env[1:-1] < env[2:]))[0] + 1
    sides = [_skirt(env, low[low < peak][::-1], peak, dt, half, ratio, 0), _skirt(env, low[low > peak], peak, dt, half, ratio, n - 1)]
    if all(sides):
        inner, skirt = max(s[0] for s in sides), max(s[1] - s[0] for s in sides)
        sides = [(inner, inner + skirt)] * 2
    window, at = np.ones(n), np.arange(n)
    for sign, side in zip((-1, 1), sides, strict=True):
        if side:
            first, last = (int(np.rint(np.clip(peak + sign * factor * s, 0, n - 1))) for s in side)
            out = at < first if sign < 0 else at >= first
            steps = first - 1 - at[out] if sign < 0 else at[out] - first
            window[out] = np.exp(-0.5 * (steps / (abs(last - first) + 1)) ** 2)
    return window


def phase_matched(data: np.ndarray, dt: float, distance: float, periods: np.ndarray, velocity: np.ndarray, alpha: float = 20.0, nalpha: float = 2.0, half: float = 5.0, ratio: float = 0.2, factor: float = 1.0) -> np.ndarray:
    """Signal of one branch: dispersion is undone by the integral of its group delay, the compressed pulse is cut out between envelope minima with Gaussian skirts, and dispersed again."""
    order = np.argsort(periods)[::-1]
    periods, velocity = periods[order], velocity[order]
    omega = TAU / periods
    keep = np.concatenate([[True], np.diff(omega) > 0])
    omega, delay = omega[keep], distance / velocity[keep]
    n = len(data)
    f = np.fft.fftfreq(n, dt)
    phase = np.zeros(n)
    inside = (TAU * f >= omega[0]) & (TAU * f <= omega[-1])
    phase[inside] = _spline_integral(omega, delay - delay[0], TAU * f[inside])
    lo, hi, part = 1 / periods.max(), 1 / periods.min(), 1 / math.sqrt(nalpha * alpha)
    corners = (lo * (1 - part), lo * (1 + part), hi, hi * (1 + part))
    taper = np.interp(f, corners, (0, 1, 1, 0), left=0, right=0)
    taper = 0.5 * (1 - np.cos(np.pi * taper))
    z = np.fft.ifft(analytic_spectrum(data, n) * np.exp(1j * phase) * taper)
    cleaned = z.real * pulse_window(np.abs(z), dt, half, ratio, factor)
    return np.fft.ifft(analytic_spectrum(cleaned, n) * np.exp(-1j * phase)).real


def phase_matched_filter(samples: DataFrame, branches: DataFrame, alpha: float = 20.0) -> DataFrame:
    """(trace_id, i, t, v): every trace cleaned by its own branch (trace_id, period, group_velocity, distance). Traces with fewer than two usable periods give no rows."""
    ok = branches.filter("period > 0 AND group_velocity > 0").groupBy("trace_id").agg(F.collect_list(F.struct("period", "group_velocity")).alias("c"), F.first("distance").alias("distance")).filter(F.size("c") > 1)
    rows = sample_arrays(samples).join(ok, "trace_id").select("trace_id", "b", "dt", "a", F.col("c.period").alias("p"), F.col("c.group_velocity").alias("u"), "distance")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, b, dt, a, p, u, d in pdf.itertuples(index=False, name=None):
                v = phase_matched(np.asarray(a), dt, d, np.asarray(p), np.asarray(u), alpha)
                i = np.arange(len(v), dtype=np.int32)
                yield pd.DataFrame({"trace_id": k, "i": i, "t": b + i * dt, "v": v})

    return rows.mapInPandas(run, "trace_id long, i int, t double, v double")


def second_pass(samples: DataFrame, picks: DataFrame, distance: DataFrame, low: float, high: float, count: int, alpha: float = 20.0) -> DataFrame:
    """Picks of the cleaned traces: the first pass's instantaneous periods and group velocities clean each trace, and their range within [low, high], spaced by a factor, gives its new target periods.

    Traces with fewer than two usable periods or an empty range give no rows.
    """
    from .traces import best_candidates, peak_candidates

    ok = picks.filter("instant_period > 0 AND group_velocity > 0")
    cleaned = cut(phase_matched_filter(samples, ok.join(distance.select("trace_id", "distance"), "trace_id").select("trace_id", F.col("instant_period").alias("period"), "group_velocity", "distance"), alpha))
    ends = ok.groupBy("trace_id").agg(F.greatest(F.lit(low), F.min("instant_period")).alias("p0"), F.least(F.lit(high), F.max("instant_period")).alias("p1"), F.count("*").alias("n")).filter("n > 1 AND p1 > p0")
    place = F.sequence(F.lit(0), F.lit(count - 1))
    targets = ends.select("trace_id", F.transform(place, lambda i: F.col("p0") * F.pow(F.col("p1") / F.col("p0"), i / (count - 1))).alias("periods"))
    own = targets.join(distance.select("trace_id", "distance"), "trace_id")
    return best_candidates(peak_candidates(ftan_arrays(cleaned, None, alpha, own)))


def _triggers(log_period: np.ndarray, velocity: np.ndarray, threshold: float) -> np.ndarray:
    """1 or -1 where the second divided difference passes the threshold upwards or downwards, else 0; 0 at the ends."""
    bend = np.zeros(len(velocity))
    if len(velocity) > 2:
        slope = np.diff(velocity) / np.diff(log_period)
        bend[1:-1] = np.diff(slope) / (log_period[2:] - log_period[:-2])
    return np.sign(bend) * (np.abs(bend) > threshold)


def branch_choice(periods: np.ndarray, options: list[np.ndarray], first: np.ndarray, threshold: float, jump_points: int) -> tuple[np.ndarray, int, int]:
    """(candidate of each period, first period, last period) of the repaired branch of one curve.

    ``options`` holds each period's candidate velocities and ``first`` the preferred one. A jump goes straight from one
    sign of trigger to the other. The periods from one jump up to the next, at most ``jump_points``, are walked through
    on trial, each taking the candidate nearest to the velocity before it; the walk stays if it leaves no trigger from
    the period before it to the one after. The branch is the longest stretch between triggers that are left and the ends,
    both included.
    """
    x, choice = np.log(periods), first.copy()
    velocity = np.array([v[k] for v, k in zip(options, choice, strict=True)])
    signs = _triggers(x, velocity, threshold)
    jumps = np.flatnonzero(signs[1:] * signs[:-1] < 0) + 1
    for begin, end in zip(jumps[:-1].tolist(), jumps[1:].tolist(), strict=True):
        if end - begin > jump_points:
            continue
        walk, speed = choice.copy(), velocity.copy()
        for k in range(begin, end):
            walk[k] = np.abs(options[k] - speed[k - 1]).argmin()
            speed[k] = options[k][walk[k]]
        after = _triggers(x, speed, threshold)
        if not after[begin - 1 : end + 1].any():
            choice, velocity, signs = walk, speed, after
    if not signs.any():
        return choice, 0, len(choice) - 1
    borders = np.unique([0, *np.flatnonzero(signs), len(choice) - 1])
    k = int(np.diff(borders).argmax()) if len(borders) > 1 else 0
    return choice, int(borders[k]), int(borders[min(k + 1, len(borders) - 1)])


def repair_jumps(picks: DataFrame, threshold: float, jump_points: int, curve: str = "trace_id", by: str = "group_velocity", keep: tuple[str, ...] = ()) -> DataFrame:
    """(curve, keep, period, fields of the chosen candidate, replaced, initial_count): each curve's repaired branch, cut to its longest smooth stretch.

    ``picks`` has one row for each curve and period with an array ``candidates`` of structs and ``best``, the place of
    the preferred one. Only the candidates' velocities ``by`` go to the walk, one call for a batch of curves; what else
    a candidate holds is carried along in the JVM. Candidates without a velocity are not taken; a period without any is
    left out. ``keep`` are columns of the curve.
    """
    usable = F.filter("candidates", lambda c: c[by].isNotNull())
    preferred = F.get("candidates", F.col("best"))
    # Without a velocity of its own the preferred candidate gives way to the first one that has one.
    best = F.greatest(F.coalesce(F.array_position(usable, preferred) - 1, F.lit(0)), F.lit(0)).cast("int")
    d = picks.select(curve, *keep, "period", usable.alias("candidates"), best.alias("best"))
    whole = d.groupBy(curve).agg(F.array_sort(F.collect_list(F.struct("period", "candidates", "best"))).alias("p"), *[F.first(c).alias(c) for c in keep])
    # A filter on rows of ``picks`` would be spelled out below all the array expressions that made them.
    whole = whole.withColumn("p", F.filter("p", lambda x: F.size(x["candidates"]) > 0)).filter(F.size("p") > 0)

    @F.pandas_udf("struct<choice: array<int>, first: int, last: int>")
    def walked(periods: pd.Series, options: pd.Series, best: pd.Series) -> pd.DataFrame:
        found = [branch_choice(np.asarray(p, float), [np.asarray(v, float) for v in o], np.asarray(b, int), threshold, jump_points) for p, o, b in zip(periods, options, best, strict=True)]
        return pd.DataFrame({"choice": [c.tolist() for c, _, _ in found], "first": [a for _, a, _ in found], "last": [z for _, _, z in found]})

    speeds = F.transform("p", lambda x: F.transform(x["candidates"], lambda c: c[by].cast("double")))
    d = whole.withColumn("w", walked(F.col("p.period"), speeds, F.col("p.best")))
    chosen = F.transform("p", lambda x, k: F.struct(x["period"].alias("period"), F.get(x["candidates"], F.get(F.col("w.choice"), k)).alias("c"), (F.get(F.col("w.choice"), k) != x["best"]).alias("replaced")))
    cut_ = F.slice(chosen, F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + 1)
    return d.select(curve, *keep, F.size("p").alias("initial_count"), F.explode_outer(cut_).alias("x")).select(curve, *keep, "x.period", "x.c.*", "x.replaced", "initial_count")


class Buckets:
    """Points of a plane in square cells, for exact searches of the nearest ones."""

    def __init__(self, points: np.ndarray, per_cell: float = 4.0) -> None:
        self.points, self.low = points, points.min(axis=0)
        span = float(np.ptp(points, axis=0).max())
        self.side = span / max(1.0, math.sqrt(len(points) / per_cell)) or 1.0
        cell = self.cell(points)
        self.nx, self.ny = (cell.max(axis=0) + 1).tolist()
        flat = cell[:, 0] * self.ny + cell[:, 1]
        self.order = np.argsort(flat, kind="stable")
        self.start = np.searchsorted(flat[self.order], np.arange(self.nx * self.ny + 1))

    def cell(self, at: np.ndarray) -> np.ndarray:
        return np.floor((at - self.low) / self.side).astype(np.int64)

    def squares(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """(indexes, reach) of growing squares of cells around a place: all points nearer than ``reach`` are among the indexes."""
        cx, cy = self.cell(at).tolist()
        r = 1
        while True:
            y0, y1 = max(0, cy - r), min(self.ny - 1, cy + r)
            columns = range(max(0, cx - r), min(self.nx - 1, cx + r) + 1) if y0 <= y1 else ()
            parts = [self.order[self.start[x * self.ny + y0] : self.start[x * self.ny + y1 + 1]] for x in columns]
            if cx - r <= 0 and cy - r <= 0 and cx + r >= self.nx - 1 and cy + r >= self.ny - 1:
                yield self.order, math.inf
                return
            yield (np.concatenate(parts) if parts else self.order[:0]), r * self.side * (1 - 1e-9)
            r *= 2

    def nearest(self, at: np.ndarray, k: int) -> np.ndarray:
        """Indexes of the k points nearest to a place, in order, the lower index on ties."""
        for own, reach in self.squares(at):
            if len(own) >= k or reach == math.inf:
                d = ((at - self.points[own]) ** 2).sum(axis=-1)
                first = np.lexsort((own, d))[:k]
                if reach == math.inf or d[first[-1]] < reach * reach:
                    return own[first]
        raise AssertionError("the last square holds all points")

    def nearest_taken(self, at: np.ndarray, turn: np.ndarray) -> int:
        """Index of the nearest point with a turn (0 or more), the earlier turn on ties."""
        for own, reach in self.squares(at):
            own = own[turn[own] >= 0]
            if len(own):
                d = np.hypot(at[0] - self.points[own, 0], at[1] - self.points[own, 1])
                k = np.lexsort((turn[own], d))[0]
                if d[k] < reach:
                    return int(own[k])
        raise AssertionError("no point has a turn")


#: Receivers of a source up to which all distances are held at once.
MATRIX = 1024


def unwrap_times(x: np.ndarray, y: np.ndarray, distance: np.ndarray, time: np.ndarray, period: float, max_residual: float, trials: int, stride: int, matrix: int = MATRIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(time, valid, cycles, residual): travel times of one source moved by whole periods to agree with their neighbours.

    From each of several seeds near the centre, receivers are visited outwards; each takes the number of periods that
    brings it nearest to the velocity of its closest accepted neighbour. The seed with most valid receivers, then the
    smallest residual, wins. Few receivers keep the distance to their closest neighbour up to date from a matrix; many
    look it up in square cells, so time and memory follow their number.
    """
    n = len(x)
    if n < 2:
        return time, np.ones(n, bool), np.zeros(n, int), np.zeros(n)
    seeds = np.argsort(np.hypot(x - x.mean(), y - y.mean()), kind="stable")[::stride][: max(1, trials)]
    apart = np.hypot(x[:, None] - x, y[:, None] - y) if n <= matrix else None
    places = np.column_stack([x, y])
    cells = Buckets(places) if apart is None else None
    far, measured = distance.tolist(), time.tolist()
    best = None
    for seed in seeds.tolist():
        t, res, cycles, ok = [math.nan] * n, [math.nan] * n, [0] * n, [False] * n
        t[seed], res[seed], ok[seed] = measured[seed], 0.0, True
        if apart is not None:
            gap = apart[seed].copy()
            nearest = np.full(n, seed)
        else:
            gap, turn, taken = np.hypot(x - x[seed], y - y[seed]), np.full(n, -1), 1
            turn[seed] = 0
        for i in np.argsort(gap, kind="stable").tolist():
            if i == seed:
                continue
            j = int(nearest[i]) if apart is not None else cells.nearest_taken(places[i], turn)
            predicted = far[i] * t[j] / far[j]
            k = round((predicted - measured[i]) / period)
            moved = measured[i] + k * period
            cycles[i], res[i] = k, abs(moved - predicted)
            if moved > 0 and res[i] <= max_residual:
                t[i], ok[i] = moved, True
                if apart is not None:
                    closer = apart[i] < gap
                    nearest[closer] = i
                    np.minimum(gap, apart[i], out=gap)
                else:
                    turn[i] = taken
                    taken += 1
        good = np.array(ok)
        score = (int(good.sum()), -float(np.array(res)[good].sum()))
        if best is None or score > best[0]:
            best = score, (np.array(t), good, np.array(cycles), np.array(res))
    return best[1]


#: Distances of receivers that are held at once by many sources.
HELD = 1 << 20


def unwrap_many(x: np.ndarray, y: np.ndarray, distance: np.ndarray, time: np.ndarray, sizes: np.ndarray, periods: np.ndarray, max_residual: float, trials: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``unwrap_times`` of many sources, whose receivers follow each other in the arrays: sources of like size take each visit together."""
    t, ok, cycles, res = time.copy(), np.ones(len(x), bool), np.zeros(len(x), np.int64), np.zeros(len(x))
    starts = np.cumsum(sizes) - sizes
    todo = np.argsort(sizes, kind="stable")
    todo = todo[sizes[todo] > 1].tolist()
    while todo:
        n = int(sizes[todo[-1]])
        some = todo[-max(1, HELD // (n * n)) :]
        del todo[-len(some) :]
        own = [slice(starts[g], starts[g] + sizes[g]) for g in some]
        if n > MATRIX:
            for g, at in zip(some, own, strict=True):
                t[at], ok[at], cycles[at], res[at] = unwrap_times(x[at], y[at], distance[at], time[at], float(periods[g]), max_residual, trials, stride)
            continue
        # Shorter sources are filled up with far places without a time, which are never accepted.
        px, py, far, measured = (np.full((len(some), n), fill) for fill in (1e18, 1e18, 1.0, np.nan))
        for i, at in enumerate(own):
            m = at.stop - at.start
            px[i, :m], py[i, :m], far[i, :m], measured[i, :m] = x[at], y[at], distance[at], time[at]
        apart = np.hypot(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :])
        seeds = [np.argsort(np.hypot(x[at] - x[at].mean(), y[at] - y[at].mean()), kind="stable")[::stride][: max(1, trials)] for at in own]
        group, seed = np.repeat(np.arange(len(some)), [len(k) for k in seeds]), np.concatenate(seeds)
        row, period = np.arange(len(group)), periods[some].astype(float)[group]
        gap = apart[group, seed]
        order, nearest = np.argsort(gap, axis=1, kind="stable"), np.repeat(seed[:, None], n, axis=1)
        t_, res_ = np.full(gap.shape, np.nan), np.full(gap.shape, np.nan)
        ok_, cycles_ = np.zeros(gap.shape, bool), np.zeros(gap.shape, np.int64)
        t_[row, seed], res_[row, seed], ok_[row, seed] = measured[group, seed], 0.0, True
        for i in order.T:
            j = nearest[row, i]
            predicted = far[group, i] * t_[row, j] / far[group, j]
            k = np.rint((predicted - measured[group, i]) / period)
            moved = measured[group, i] + k * period
            off = np.abs(moved - predicted)
            live = (i != seed) & ~np.isnan(moved)
            cycles_[row[live], i[live]], res_[row[live], i[live]] = k[live].astype(np.int64), off[live]
            good = np.nonzero(live & (moved > 0) & (off <= max_residual))[0]
            at = i[good]
            t_[good, at], ok_[good, at] = moved[good], True
            d = apart[group[good], at]
            closer = d < gap[good]
            nearest[good] = np.where(closer, at[:, None], nearest[good])
            gap[good] = np.where(closer, d, gap[good])
        at = 0
        for place, found in zip(own, seeds, strict=True):
            m = place.stop - place.start
            best = max(range(at, at + len(found)), key=lambda r: (int(ok_[r].sum()), -float(res_[r][ok_[r]].sum())))
            t[place], ok[place], cycles[place], res[place] = t_[best, :m], ok_[best, :m], cycles_[best, :m], res_[best, :m]
            at += len(found)
    return t, ok, cycles, res


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind, from_pandas=True))


def corrected(lon: np.ndarray, lat: np.ndarray, distance: np.ndarray, time: np.ndarray, sizes: np.ndarray, periods: np.ndarray, max_residual: float = 3.0, trials: int = 5, stride: int = 3, min_period: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(time, valid, cycles, residual) of the receivers of many sources, which follow each other in the arrays. Times that are not valid stay as measured."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    mean = lambda v: np.repeat([v[i:j].mean() if j > i else 0.0 for i, j in zip(ends[:-1], ends[1:], strict=True)], sizes)
    lon0, lat0 = mean(lon), mean(lat)
    x, y = np.radians(lon - lon0) * np.cos(np.radians(lat0)) * EARTH_RADIUS_KM, np.radians(lat - lat0) * EARTH_RADIUS_KM
    counted = np.where(periods < min_period, 0, sizes)
    t, ok, cycles, res = time.copy(), np.ones(len(x), bool), np.zeros(len(x), np.int64), np.zeros(len(x))
    use = np.repeat(counted > 0, sizes)
    t[use], ok[use], cycles[use], res[use] = unwrap_many(x[use], y[use], distance[use], time[use], counted[counted > 0], periods[counted > 0], max_residual, trials, stride)
    return np.where(ok, t, time), ok, cycles, res


def correct_cycle_skips(points: DataFrame, max_residual: float = 3.0, trials: int = 5, stride: int = 3, min_period: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (period_s, source, receiver, rcv_lon, rcv_lat, distance_km, travel_time, columns to ``keep``) with corrected ``travel_time``, ``cycles``, ``residual`` and ``valid``, per source and period.

    A source and period is one row of arrays on its way to Python, so sources are corrected many at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    key, own = ["period_s", "source"], ["receiver", "rcv_lon", "rcv_lat", "distance_km", "travel_time"]
    settle(points.sparkSession)
    numbers = [F.col(c).cast("double").alias(c) for c in own[1:]]
    # No filter: it would be pushed below the projections that make the distance, which would be spelled out in it.
    usable = F.when((F.col("distance_km") > 0) & (F.col("travel_time") > 0), F.struct("receiver", *numbers, *keep))
    rows = points.groupBy(*key).agg(F.sort_array(F.collect_list(usable)).alias("p")).filter(F.size("p") > 0).select(*key, *[F.col(f"p.{c}").alias(c) for c in (*own, *keep)])
    added = ", ".join(["cycles array<int>", "residual array<double>", "valid array<boolean>"])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, {added}"
    target = to_arrow_schema(type(rows.schema).fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            lon, lat, distance, time = (_flat(b.column(c)) for c in own[1:])
            sizes = b.column("receiver").value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            t, ok, cycles, res = corrected(lon, lat, distance, time, sizes, b.column("period_s").to_numpy(zero_copy_only=False), max_residual, trials, stride, min_period)
            out = {c: b.column(c) for c in (*key, *own, *keep)} | {"travel_time": _lists(t, ends, pa.float64()), "cycles": _lists(cycles, ends, pa.int32()), "residual": _lists(res, ends, pa.float64()), "valid": _lists(ok, ends, pa.bool_())}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in target], schema=target)

    return rows.mapInArrow(run, schema).select(*key, F.inline(F.arrays_zip(*own, *keep, "cycles", "residual", "valid")))


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """r^2 log r of all pairs of two point sets, along the last two axes."""
    r2 = (a[..., :, None, 0] - b[..., None, :, 0]) ** 2 + (a[..., :, None, 1] - b[..., None, :, 1]) ** 2
    return 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1.0))


def _system(points: np.ndarray, values: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and right side of the thin-plate spline with a linear part through one or many sets of points, from the kernel of their pairs."""
    n = points.shape[-2]
    m = np.zeros((*points.shape[:-2], n + 3, n + 3))
    m[..., :n, :n] = kernel
    m[..., :n, n] = 1
    m[..., :n, n + 1 :] = points
    m[..., n:, :n] = np.swapaxes(m[..., :n, n:], -1, -2)
    return m, np.concatenate([values, np.zeros((*values.shape[:-1], 3))], axis=-1)[..., None]


def _smoothed(m: np.ndarray, right: np.ndarray, smoothing: float | np.ndarray) -> np.ndarray:
    """Coefficients of a system with a smoothing, which is all that the diagonal of its points holds."""
    at = np.arange(m.shape[-1] - 3)
    m[..., at, at] = smoothing
    return np.linalg.solve(m, right)[..., 0]


def _plate(points: np.ndarray, values: np.ndarray, smoothing: float | np.ndarray) -> np.ndarray:
    """Coefficients of the thin-plate spline with a linear part through (or near) points, for one or many sets of points."""
    return _smoothed(*_system(points, values, _kernel(points, points)), smoothing)


#: Neighbours up to which local systems are eliminated side by side, and numbers of their kernels that are held at once.
SMALL, BLOCK = 24, 1 << 16


def _eliminated(a: np.ndarray, points: np.ndarray, z: np.ndarray, h: np.ndarray, at: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value of each system for each weight, systems that can be trusted) of small thin-plate systems side by side, along the last axis.

    ``a`` (n, n, systems) holds the kernels of the points (2, n, systems), which is overwritten; ``z`` their values, ``h`` the kernels
    to the queried places ``at`` (2, systems), and a weight is what a system's diagonal holds. Reflections turn the linear
    part into the first three unknowns, so all smoothings share what is left: a positive definite matrix, eliminated
    without pivots for the queried value alone. Systems without three points off a line, or with a small pivot, are not trusted.
    """
    n, m = z.shape
    p = np.concatenate([np.ones((1, n, m)), points])
    z, h = z.copy(), h.copy()
    with np.errstate(all="ignore"):
        for j in range(3):
            x = p[j, j:]
            norm = np.sqrt((x * x).sum(axis=0))
            beta, v = 1 / (norm * (norm + np.abs(x[0]))), x.copy()
            v[0] += np.copysign(norm, x[0])
            for y in (*p[j:], z, h):
                y[j:] -= beta * (v * y[j:]).sum(axis=0) * v
            own = a[j:, j:]
            u = beta * np.einsum("ijm,jm->im", own, v)
            u -= 0.5 * beta * (u * v).sum(axis=0) * v
            own -= v[:, None] * u
            own -= u[:, None] * v
            if j:
                a[:j, j:] -= (beta * np.einsum("ijm,jm->im", a[:j, j:], v))[:, None] * v
        g0 = 1 / p[0, 0]
        g1 = (at[0] - p[1, 0] * g0) / p[1, 1]
        g2 = (at[1] - p[2, 0] * g0 - p[2, 1] * g1) / p[2, 2]
        flat = g0 * z[0] + g1 * z[1] + g2 * z[2]
        h = h[3:] - (g0 * a[0, 3:] + g1 * a[1, 3:] + g2 * a[2, 3:])
        trusted, out, rest = np.abs(p[2, 2]) > 1e-6 * np.abs(p[1, 1]), np.empty((len(weights), m)), np.arange(n - 3)
        for f, w in zip(out, weights, strict=True):
            b = np.concatenate([a[3:, 3:], z[3:, None], h[:, None]], axis=1)
            b[rest, rest] += w
            least, f[:] = 1e-10 * b[rest, rest].max(axis=0), flat
            for i in rest:
                d, row = b[i, i], b[i, i + 1 :]
                trusted &= d > least
                f += row[-1] * row[-2] / d
                b[i + 1 :, i + 1 :] -= (row[:-2] / d)[:, None] * row
    return out, trusted & np.isfinite(out).all(axis=0)


def thin_plate(points: np.ndarray, values: np.ndarray, query: np.ndarray, smoothing: float = 0.0, neighbours: int | None = None, chunk: int = 512) -> np.ndarray:
    """Thin-plate spline r^2 log r with a linear part, through (or near) scattered values.

    One system of all points by default; with ``neighbours`` each queried place has a system of its own nearest points
    (the first ones on ties), so memory no longer grows with the square of the points. Places are taken in chunks.
    """
    centre, scale = points.mean(axis=0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    p, q = (points - centre) / scale, (query - centre) / scale
    near = min(neighbours, len(p)) if neighbours is not None else None
    c = _plate(p, values, smoothing / scale**2) if near is None else None
    cells = Buckets(p) if near is not None else None
    out = np.empty(len(q))
    for i in range(0, len(q), chunk):
        own = q[i : i + chunk]
        if near is None:
            out[i : i + chunk] = _kernel(own, p) @ c[: len(p)] + c[len(p)] + own @ c[len(p) + 1 :]
        else:
            at = np.array([cells.nearest(place, near) for place in own])
            w = _plate(p[at], values[at], smoothing / scale**2)
            out[i : i + chunk] = (_kernel(own[:, None], p[at])[:, 0] * w[:, :near]).sum(axis=1) + w[:, near] + (own * w[:, near + 1 :]).sum(axis=1)
    return out


def thin_plates(points: np.ndarray, values: np.ndarray, query: np.ndarray, smoothings: tuple[float, ...], neighbours: int | None = None, chunk: int = 512) -> np.ndarray:
    """``thin_plate`` of many sets of equally many points (sets, n, 2) at the same places, for each smoothing: (smoothings, sets, places).

    The smoothings share distances and nearest points.
    """
    sets, n = values.shape
    centre, scale = points.mean(axis=1, keepdims=True), np.maximum(np.ptp(points, axis=1).max(axis=-1), 1e-9)[:, None, None]
    p, q = (points - centre) / scale, (query[None] - centre) / scale
    weight = [s / scale**2 for s in smoothings]
    out = np.empty((len(smoothings), sets, len(query)))
    if neighbours is None or neighbours >= n:
        system = _system(p, values, _kernel(p, p))
        whole = [_smoothed(*system, w[..., 0]) for w in weight]
        for i in range(0, len(query), chunk):
            own = q[:, i : i + chunk]
            k = _kernel(own, p)
            for c, o in zip(whole, out, strict=True):
                o[:, i : i + chunk] = (k @ c[:, :n, None])[..., 0] + c[:, n, None] + (own @ c[:, n + 1 :, None])[..., 0]
        return out
    which = np.arange(sets)[:, None, None]
    # Neighbours of many places are pairs of the same points; the kernel of all pairs is cheaper unless there are many points.
    pairs = _kernel(p, p) if n * n <= min(MATRIX * MATRIX, len(query) * neighbours * neighbours) else None
    for i in range(0, len(query), chunk):
        own = q[:, i : i + chunk]
        if n <= MATRIX:
            d = (own[:, :, None, 0] - p[:, None, :, 0]) ** 2 + (own[:, :, None, 1] - p[:, None, :, 1]) ** 2
            at = np.argsort(d, axis=-1, kind="stable")[..., :neighbours]
        else:
            cells = [Buckets(x) for x in p] if i == 0 else cells  # noqa: F821
            at = np.array([[c.nearest(place, neighbours) for place in x] for c, x in zip(cells, own, strict=True)])
        if pairs is not None and 4 <= neighbours <= SMALL:
            out[:, :, i : i + chunk] = _small(p, values, pairs, own, at, weight)
        else:
            near = p[which, at]
            k, system = _kernel(own[:, :, None], near)[:, :, 0], _system(near, values[which, at], _kernel(near, near))
            for w, o in zip(weight, out, strict=True):
                c = _smoothed(*system, w)
                o[:, i : i + chunk] = (k * c[..., :neighbours]).sum(axis=-1) + c[..., neighbours] + (own * c[..., neighbours + 1 :]).sum(axis=-1)
    return out


def _off_a_line(points: np.ndarray) -> np.ndarray:
    """Whether the points (2, n, systems) of each system spread to both sides of a line by more than a millionth of their extent along it."""
    x, y = points - points.mean(axis=1, keepdims=True)
    xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
    half = (xx + yy) / 2
    along = half + np.hypot((xx - yy) / 2, xy)
    # The cross product with the longest direction, since a difference of the sums would hold rounding only.
    turn = 0.5 * np.arctan2(2 * xy, xx - yy)
    across = x * np.sin(turn) - y * np.cos(turn)
    return (across * across).sum(axis=0) > 1e-12 * along


def _small(p: np.ndarray, values: np.ndarray, pairs: np.ndarray, query: np.ndarray, at: np.ndarray, weight: list[np.ndarray]) -> np.ndarray:
    """Values at the places (sets, places, 2), whose nearest points are ``at``, from the kernel of all pairs; systems that cannot be eliminated are solved."""
    (sets, n), (_, places, near) = values.shape, at.shape
    # The systems lie side by side in memory too, which ``take`` keeps.
    at, place, every = (np.ascontiguousarray(x.T) for x in (at.reshape(-1, near), query.reshape(-1, 2), p.reshape(-1, 2)))
    which, kernels, value = np.repeat(np.arange(sets), places), pairs.reshape(-1), values.reshape(-1)
    row, weight = which * n + at, [w.reshape(-1)[which] for w in weight]
    around = every.take(row, axis=1)
    r2 = ((place[:, None] - around) ** 2).sum(axis=0)
    k = 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1.0))
    out, trusted = np.empty((len(weight), sets * places)), np.zeros(sets * places, bool)
    step = max(1, BLOCK // (near * near))

    def blocks(wanted: np.ndarray) -> Iterator[np.ndarray]:
        found = np.flatnonzero(wanted)
        return (found[i : i + step] for i in range(0, len(found), step))

    for some in blocks(_off_a_line(around)):
        own, there = row.take(some, axis=1), at.take(some, axis=1)
        out[:, some], trusted[some] = _eliminated(kernels.take(own[:, None] * n + there), around.take(some, axis=2), value.take(own), k.take(some, axis=1), place.take(some, axis=1), [w[some] for w in weight])
    for some in blocks(~trusted):
        own, there = (np.ascontiguousarray(x.take(some, axis=1).T) for x in (row, at))
        system = _system(every.T.take(own, axis=0), value.take(own), kernels.take(own[:, :, None] * n + there[:, None, :]))
        for w, o in zip(weight, out, strict=True):
            c = _smoothed(*system, w[some, None])
            o[some] = (k[:, some].T * c[:, :near]).sum(axis=-1) + c[:, near] + (place[:, some].T * c[:, near + 1 :]).sum(axis=-1)
    return out.reshape(len(weight), sets, places)


#: Kernels of scattered values by name; further ones may be added. Each takes places in km (n, 2), their values (n,), queried
#: places (m, 2), a smoothing and a number of neighbours or None, and returns the m values; it may raise LinAlgError.
KERNELS: dict[str, Callable[..., np.ndarray]] = {"thin_plate": thin_plate}


def grid_travel_times(points: DataFrame, grid: DataFrame, value: str = "travel_time", smoothing: float = 0.0, comparison: float | None = 1.0, source_at_zero: bool = True, neighbours: int | None = None, tiles: int = 1, kernel: str = "thin_plate") -> DataFrame:
    """(period_s, source, i_lat, i_lon, value, other): each source's scattered values on the grid.

    Points at equal places are merged to their median; the source itself is a point of value 0. ``other`` is a second,
    smoother solution. Groups with fewer than three points, or a singular system, give no rows. The grid is one bounded
    table, broadcast to the kernels. One source and period is one solve; with ``neighbours`` the solves are local, and
    ``tiles`` deals the cells of a source to so many tasks. ``kernel`` is one of KERNELS.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; there are {sorted(KERNELS)}")
    solve = KERNELS[kernel]
    shared = _shared_grid(grid)
    if neighbours is None and tiles != 1:
        raise ValueError("tiles need local solves; give a number of neighbours")
    found = _solved(points, shared, value, smoothing, comparison, source_at_zero, neighbours, tiles, solve)
    return found.select("period_s", "source", F.inline(F.arrays_zip("i_lat", "i_lon", "value", "other")))


def _shared_grid(grid: DataFrame) -> Any:
    """Broadcast (i_lat, i_lon, middle, places in km) of a map."""
    cells = grid.select("i_lat", "i_lon", "lat", "lon").orderBy("i_lat", "i_lon").toPandas()
    middle = (cells["lon"].min() + cells["lon"].max()) / 2, (cells["lat"].min() + cells["lat"].max()) / 2
    return grid.sparkSession.sparkContext.broadcast((cells["i_lat"].to_numpy(np.int32), cells["i_lon"].to_numpy(np.int32), middle, place(middle, cells["lon"].to_numpy(), cells["lat"].to_numpy())))


def _merged(x: np.ndarray, y: np.ndarray, v: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points of many sources in the order of their places, and how many each source has; a source's points at one place become their median."""
    who = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((v, y, x, who))
    who, x, y, v = who[order], x[order], y[order], v[order]
    new = np.ones(len(x), bool)
    new[1:] = (who[1:] != who[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(x))
    low, high = v[first + (n - 1) // 2], v[first + n // 2]
    median = np.where(np.isnan(v[first + n - 1]), np.nan, np.where(low == high, low, (low + high) / 2))
    return x[first], y[first], median, np.bincount(who[first], minlength=len(ends) - 1)


def _solved(points: DataFrame, shared: Any, value: str, smoothing: float, comparison: float | None, source_at_zero: bool, neighbours: int | None, tiles: int, solve: Callable[..., np.ndarray]) -> DataFrame:
    """(period_s, source, i_lat, i_lon, value, other): the solutions of a source and tile as one row of arrays. ``shared`` is the broadcast grid."""
    from pyspark.sql.pandas.types import to_arrow_schema

    settle(points.sparkSession)
    key = ["period_s", "source"]
    good = F.col("rcv_lon").isNotNull() & F.col("rcv_lat").isNotNull() & F.col(value).isNotNull()
    own = F.collect_list(F.when(good, F.struct(F.col("rcv_lon").alias("x"), F.col("rcv_lat").alias("y"), F.col(value).cast("double").alias("v"))))
    start = F.collect_set(F.when(F.col("src_lon").isNotNull() & F.col("src_lat").isNotNull(), F.struct(F.col("src_lon").alias("x"), F.col("src_lat").alias("y"), F.lit(0.0).alias("v")))) if source_at_zero else F.array()
    rows = points.groupBy(*key).agg(own.alias("p"), *([start.alias("o")] if source_at_zero else []))
    rows = rows.withColumn("p", F.concat("p", "o")) if source_at_zero else rows
    rows = rows.filter(F.size("p") >= 3 + source_at_zero).select(*key, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "p.x", "p.y", "p.v")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    ddl = f"period_s {kinds['period_s']}, source {kinds['source']}, i_lat array<int>, i_lon array<int>, value array<double>, other array<double>"
    target = to_arrow_schema(type(rows.schema).fromDDL(ddl))
    smoothings = (smoothing,) if comparison is None else (smoothing, comparison)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i_lat, i_lon, flat, query = shared.value
        for b in batches:
            x, y, v = (_flat(b.column(c)) for c in ("x", "y", "v"))
            ends = np.concatenate([[0], np.cumsum(b.column("x").value_lengths().to_numpy())])
            for who, at, t in solutions(x, y, v, ends, flat, query, smoothings, 3 + source_at_zero, neighbours, solve, tiles, b.column("tile").to_numpy()):
                edges = np.arange(len(who) + 1) * len(at)
                other = t[1].ravel() if comparison is not None else np.full(edges[-1], np.nan)
                columns = [b.column("period_s").take(pa.array(who)), b.column("source").take(pa.array(who)), *(_lists(np.tile(c[at], len(who)), edges, pa.int32()) for c in (i_lat, i_lon)), _lists(t[0].ravel(), edges, pa.float64()), _lists(other, edges, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return rows.mapInArrow(run, ddl)


def solutions(x: np.ndarray, y: np.ndarray, v: np.ndarray, ends: np.ndarray, middle: tuple[float, float], query: np.ndarray, smoothings: tuple[float, ...], least: int, neighbours: int | None, solve: Callable[..., np.ndarray], tiles: int = 1, tile: np.ndarray | None = None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(sources, places, solutions (smoothings, sources, places)) of scattered values, those of source ``i`` from ``ends[i]`` on; sources of like size are solved together.

    Sources of fewer than ``least`` places, and singular systems, are left out. ``tile`` deals the queried places.
    """

    def found_of(at: np.ndarray, v: np.ndarray, own: np.ndarray) -> np.ndarray | None:
        try:
            if solve is thin_plate:
                return thin_plates(at, v, own, smoothings, neighbours)
            return np.array([[solve(a, b, own, s, neighbours) for a, b in zip(at, v, strict=True)] for s in smoothings])
        except np.linalg.LinAlgError:
            return None

    px, py, v, sizes = _merged(np.round(x, 8) + 0.0, np.round(y, 8) + 0.0, v, ends)
    points, starts = place(middle, px, py), np.cumsum(sizes) - sizes
    alike: dict[tuple[int, int], list[int]] = {}
    for r, n in enumerate(sizes.tolist()):
        if n >= least:
            alike.setdefault((int(tile[r]) if tile is not None else 0, n), []).append(r)
    for (k, n), group in alike.items():
        at = np.arange(k, len(query), tiles)
        if not len(at):
            continue
        many = max(1, HELD // max(n * n, min(512, len(at)) * (max(n, 12 * neighbours) if neighbours else n)))
        for g in range(0, len(group), many):
            some = group[g : g + many]
            own = starts[some][:, None] + np.arange(n)
            p, z = points[own], v[own]
            found = found_of(p, z, query[at])
            parts = [(some, found)] if found is not None else [([r], found_of(p[i : i + 1], z[i : i + 1], query[at])) for i, r in enumerate(some)]
            yield from ((who, at, t) for who, t in parts if t is not None)


def place(middle: tuple[float, float], lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Kilometres from the middle of a map."""
    return np.column_stack([np.radians(lon - middle[0]) * math.cos(math.radians(middle[1])), np.radians(lat - middle[1])]) * EARTH_RADIUS_KM


def event_fields(
    measurements: DataFrame,
    grid: DataFrame,
    min_snr: float | None = None,
    velocity: tuple[float, float] = (2.0, 6.0),
    max_difference_s: float = 2.0,
    max_laplacian: float = 0.01,
    coverage: dict | None = None,
    reference_velocity: float = 3.0,
    wavelengths: float = 1.0,
    boundary: int = 1,
    cycle_skips: dict | None = None,
    helmholtz: bool = True,
    neighbours: int | None = None,
    min_cells: int = 1,
    min_fraction: float = 0.0,
    amplitude: dict | None = None,
    kernel: str = "thin_plate",
    columns: tuple[str, ...] | None = None,
    written: bool = True,
) -> DataFrame:
    """Gridded slowness of every source and period, with rejection codes and acceptance of both families.

    The measurements are shuffled once, into one row of arrays a source and period. Distances, cycle correction, solves, stencils,
    coverage and cascades happen in that row (``fields``), many sources at a time; no cell is shuffled. Sources with too few points appear with code 8 in every cell. ``accepted``
    (and ``helmholtz_accepted``) says whether the source keeps enough cells of its map, ``cell`` numbers the cells, and
    n_input, n_used, n_amplitude, n_corrected and n_rejected count the source's measurements; so the result can be
    written (``write_event_fields``) and stacked (``eikonal_vs_helmholtz``) as it is.

    ``amplitude`` may hold min_amplitude, max_relative_difference (of the two solutions), reference_velocity and
    min_period of the amplitude family. ``kernel`` names one of KERNELS for both. ``columns`` names those of a cell that are
    wanted. All wanted cells are written once, as arrays, since what follows often reads them twice; a result that is read
    once, like one that goes to a file, need not be (``written``). Maps are made without all cells by ``event_maps``.
    """
    made = {
        "i_lat": ("i_lat",),
        "i_lon": ("i_lon",),
        "cell": ("i_lat", "i_lon"),
        **{c: (c,) for c in ("source_km", "azimuth", "value", "other", "east", "north", "laplacian", "adjacent", "slowness")},
        "angle": ("east", "north"),
        "velocity": ("slowness",),
        "covered": ("covered",),
        "boundary": ("i_lat", "i_lon"),
        "reason": ("reason",),
        "deflection": ("east", "north", "azimuth"),
    }
    if helmholtz:
        made |= {c: (c,) for c in ("amplitude", "amplitude_other", "amplitude_laplacian", "amplitude_adjacent", "correction", "helmholtz_reason")} | {"helmholtz_slowness": ("slowness", "correction")}
    unknown = sorted(set(columns or ()) - set(made))
    if unknown:
        raise ValueError(f"unknown columns {unknown}; there are {list(made)}")
    asked = [c for c in made if columns is None or c in columns]
    listed = list(dict.fromkeys(x for c in asked for x in made[c]))
    t, n_lat, n_lon, once = _event_arrays(measurements, grid, listed, False, min_snr, velocity, max_difference_s, max_laplacian, coverage, reference_velocity, wavelengths, boundary, cycle_skips, helmholtz, neighbours, min_cells, min_fraction, amplitude, kernel)
    t = (cut(t) if written else t).select("period_s", "source", *once, F.inline(F.arrays_zip(*listed)))
    angle = wrap180(F.degrees(F.atan2("east", "north")))
    derived = {"cell": _cell(n_lon), "angle": angle, "velocity": F.when(F.col("slowness") > 0, 1 / F.col("slowness")), "deflection": wrap180(angle - F.col("azimuth")), "helmholtz_slowness": _helmholtz_slowness()}
    t = t.withColumns({c: x for c, x in derived.items() if c in asked})
    return (M.boundary_cells(t, n_lat, n_lon, boundary) if "boundary" in asked else t).select("period_s", "source", *asked, *once)


def _cell(n_lon: int) -> Column:
    return (F.col("i_lat") * n_lon + F.col("i_lon")).cast("int")


def _helmholtz_slowness() -> Column:
    s2 = F.col("slowness") * F.col("slowness") - F.col("correction")
    return F.when(s2 > 0, F.sqrt(s2))


def event_maps(
    measurements: DataFrame,
    grid: DataFrame,
    stack: dict,
    min_snr: float | None = None,
    velocity: tuple[float, float] = (2.0, 6.0),
    max_difference_s: float = 2.0,
    max_laplacian: float = 0.01,
    coverage: dict | None = None,
    reference_velocity: float = 3.0,
    wavelengths: float = 1.0,
    boundary: int = 1,
    cycle_skips: dict | None = None,
    neighbours: int | None = None,
    min_cells: int = 1,
    min_fraction: float = 0.0,
    amplitude: dict | None = None,
    kernel: str = "thin_plate",
) -> DataFrame:
    """Both stacked maps (``eikonal_vs_helmholtz`` with the settings ``stack``) of ``event_fields`` of the measurements.

    A stack takes slowness and azimuth of cells with code 0 of accepted sources, so only these are written, as arrays.
    """
    from .stack import eikonal_vs_helmholtz

    listed = ["i_lat", "i_lon", "azimuth", "slowness", "correction", "reason", "helmholtz_reason"]
    t, _, n_lon, _ = _event_arrays(measurements, grid, listed, True, min_snr, velocity, max_difference_s, max_laplacian, coverage, reference_velocity, wavelengths, boundary, cycle_skips, True, neighbours, min_cells, min_fraction, amplitude, kernel)
    t = cut(t.select("period_s", "source", "accepted", "helmholtz_accepted", *listed)).select("period_s", "source", "accepted", "helmholtz_accepted", F.inline(F.arrays_zip(*listed)))
    return eikonal_vs_helmholtz(t.withColumns({"cell": _cell(n_lon), "helmholtz_slowness": _helmholtz_slowness()}), **stack)


def _event_arrays(
    measurements: DataFrame,
    grid: DataFrame,
    wanted: list[str],
    stacked: bool,
    min_snr: float | None,
    velocity: tuple[float, float],
    max_difference_s: float,
    max_laplacian: float,
    coverage: dict | None,
    reference_velocity: float,
    wavelengths: float,
    boundary: int,
    cycle_skips: dict | None,
    helmholtz: bool,
    neighbours: int | None,
    min_cells: int,
    min_fraction: float,
    amplitude: dict | None,
    kernel: str,
) -> tuple[DataFrame, int, int, list[str]]:
    """(one row of arrays ``wanted`` a source and period, rows and columns of the map, names of what is one value a row). ``stacked`` keeps the cells with code 0 of sources that a family accepts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; there are {sorted(KERNELS)}")
    settle(measurements.sparkSession)
    own = {"min_amplitude": 0.0, "max_relative_difference": 0.01, "reference_velocity": 4.0, "min_period": 0.0} | (amplitude or {})
    key, solve, skips, near_km = ["period_s", "source"], KERNELS[kernel], cycle_skips or {}, wavelengths * reference_velocity
    d = M.valid_measurements(measurements, min_snr)
    number = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    path = ("receiver", "rcv_lon", "rcv_lat", "src_lon", "src_lat", "c")
    loud = F.when((F.col("amp") > own["min_amplitude"]) & (F.col("period_s") >= own["min_period"]), F.struct("receiver", *number("rcv_lon", "rcv_lat", "amp")))
    ordered = lambda c: F.sort_array(F.collect_list(c))
    rows = d.groupBy(*key).agg(F.count("*").alias("n_input"), ordered(F.struct("receiver", *number(*path[1:]))).alias("p"), ordered(loud).alias("a"), F.sort_array(F.collect_set(F.struct(*number("src_lon", "src_lat")))).alias("s"))
    rows = rows.filter(F.col("period_s").isNotNull() & F.col("source").isNotNull()).select(*key, "n_input", *[F.col(f"{g}.{c}").alias(f"{g}_{c}") for g, names in (("p", path), ("a", ("receiver", "rcv_lon", "rcv_lat", "amp")), ("s", ("src_lon", "src_lat"))) for c in names])
    cells = grid.select("i_lat", "i_lon", "lat", "lon", "x_km", "y_km").orderBy("i_lat", "i_lon").toPandas()
    shared = grid.sparkSession.sparkContext.broadcast(A.Map(*(cells[c].to_numpy() for c in cells)))
    size = (int(cells["i_lat"].max()) + 1) * (int(cells["i_lon"].max()) + 1)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    listed = {"i_lat": "int", "i_lon": "int", **dict.fromkeys(("source_km", "azimuth", "value", "other", "east", "north", "laplacian", "slowness"), "double"), "adjacent": "boolean", "covered": "boolean", "reason": "tinyint"}
    counted = ["n_input", "n_used", "n_amplitude", "n_corrected", "n_rejected"]
    if helmholtz:
        listed |= {**dict.fromkeys(("amplitude", "amplitude_other", "amplitude_laplacian", "correction"), "double"), "amplitude_adjacent": "boolean", "helmholtz_reason": "tinyint"}
    words = ["accepted", "helmholtz_accepted"] if helmholtz else ["accepted"]
    listed = {c: listed[c] for c in wanted}
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in key), *(f"{c} array<{t}>" for c, t in listed.items()), *(f"{c} boolean" for c in words), *(f"{c} bigint" for c in counted)])
    target = to_arrow_schema(type(rows.schema).fromDDL(ddl))

    def accept(code: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
        valid = np.bincount(who, (code == 0).sum(axis=1), n)
        return ((valid > 0) & (valid >= min_cells) & (valid / size >= min_fraction))[who]

    def fields(b: pa.RecordBatch) -> pa.RecordBatch:
        m, n = shared.value, len(b)
        flat = lambda c: _flat(b.column(c)).astype(float)
        sizes = {g: b.column(c).value_lengths().to_numpy() for g, c in (("p", "p_receiver"), ("a", "a_receiver"), ("s", "s_src_lon"))}
        of = {g: np.repeat(np.arange(n), k) for g, k in sizes.items()}
        period = b.column("period_s").to_numpy(zero_copy_only=False).astype(float)
        slon, slat, alon, alat, amp = (flat(c) for c in ("s_src_lon", "s_src_lat", "a_rcv_lon", "a_rcv_lat", "a_amp"))
        of["p"], receiver, lon, lat, distance, time = usable_paths(of["p"], b.column("p_receiver").flatten(), *(flat(f"p_{c}") for c in path[1:]))
        time, ok, cycles, _ = corrected(lon, lat, distance, time, np.bincount(of["p"], minlength=n), period, **skips)
        # Amplitudes of the receivers whose cycles hold.
        good = set(zip(of["p"][ok].tolist(), receiver.filter(pa.array(ok)).to_pylist(), strict=True))
        heard = np.fromiter((x in good and x[1] is not None for x in zip(of["a"].tolist(), b.column("a_receiver").flatten().to_pylist(), strict=True)), bool, len(amp))

        def solved(who: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            here = np.nonzero(~(np.isnan(x) | np.isnan(y) | np.isnan(v)))[0]
            here = here[np.argsort(who[here], kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(who[here], minlength=n))])
            value, other, done = np.full((n, len(m)), np.nan), np.full((n, len(m)), np.nan), np.zeros(n, bool)
            query = place(m.middle, m.lon, m.lat)
            for some, _, t in solutions(x[here], y[here], v[here], ends, m.middle, query, (0.0, 1.0), least, neighbours, solve):
                value[some], other[some], done[some] = t[0], t[1], True
            return value, other, done

        value, other, _ = solved(np.concatenate([of["p"][ok], of["s"]]), np.concatenate([lon[ok], slon]), np.concatenate([lat[ok], slat]), np.concatenate([time[ok], np.zeros(len(slon))]), 4)
        edges = np.concatenate([[0], np.cumsum(np.bincount(of["p"][ok], minlength=n))])
        cover = np.array([m.covered(lon[ok][i:j], lat[ok][i:j], **(coverage or {})) for i, j in zip(edges[:-1], edges[1:], strict=True)])
        who = of["s"]
        out = {"value": value, "other": other, "east": m.east.gradient(value), "north": m.north.gradient(value), "laplacian": m.laplacian(value), "adjacent": m.adjacent(value), "covered": cover}
        out = {c: v if np.array_equal(who, np.arange(n)) else v[who] for c, v in out.items()}
        out["source_km"], out["azimuth"] = m.geodesics(slon, slat)
        with np.errstate(all="ignore"):
            out["slowness"] = s = np.hypot(out["north"], out["east"])
            speed = 1 / s
            edge = np.broadcast_to(A.boundary(m, boundary), s.shape)
            failed = np.isnan(out["value"])
            out["reason"] = A.first_reason(
                {
                    "adjacent": out["adjacent"],
                    "unstable": np.abs(out["value"] - out["other"]) > max_difference_s,
                    "coverage": ~out["covered"],
                    "velocity": ~((s > 0) & (speed >= velocity[0]) & (speed <= velocity[1])),
                    "near_source": out["source_km"] < near_km * period[who][:, None],
                    "curvature": ~(np.abs(out["laplacian"]) <= max_laplacian),
                    "boundary": edge,
                },
                failed,
            )
            if helmholtz:
                value, other, done = solved(of["a"][heard], alon[heard], alat[heard], amp[heard], 3)
                loudness = {"amplitude": value, "amplitude_other": other, "amplitude_laplacian": m.laplacian(value), "amplitude_adjacent": m.adjacent(value)}
                out |= {c: v[who] for c, v in loudness.items()}
                omega = TAU / period[who][:, None]
                out["correction"] = np.where(out["amplitude"] == 0, np.nan, out["amplitude_laplacian"] / (out["amplitude"] * omega * omega))
                unstable = np.abs(out["amplitude"] - out["amplitude_other"]) > own["max_relative_difference"] * np.abs(out["amplitude"])
                out["helmholtz_reason"] = A.helmholtz_reason(out["reason"], out["amplitude"], out["correction"], s, own["reference_velocity"], unstable, done[who][:, None] & np.ones(s.shape, bool), out["amplitude_adjacent"], own["min_amplitude"])
        out["i_lat"], out["i_lon"] = (np.broadcast_to(c, s.shape) for c in (m.i_lat, m.i_lon))
        words_of = {w: accept(out[c], who, n) for w, c in zip(words, ("reason", "helmholtz_reason"), strict=False)}
        ends = np.arange(len(who) + 1) * len(m)
        if stacked:
            kept = (out["reason"] == 0) & np.any(list(words_of.values()), axis=0)[:, None]
            ends, out = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]), {c: out[c][kept] for c in listed}
        once = {"n_input": b.column("n_input").to_numpy(), "n_used": np.bincount(of["p"], ok, n), "n_corrected": np.bincount(of["p"], ok & (cycles != 0), n), "n_rejected": np.bincount(of["p"], ~ok, n), "n_amplitude": np.bincount(of["a"], heard, n)}
        columns = {c: b.column(c).take(pa.array(who)) for c in key} | {c: pa.array(v[who].astype(np.int64)) for c, v in once.items()}
        columns |= {w: pa.array(v) for w, v in words_of.items()}
        columns |= {c: _lists(out[c].ravel(), ends, target.field(c).type.value_type) for c in listed}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // (2 * len(shared.value)))
        for b in batches:
            for at in range(0, len(b), step):
                yield fields(b.slice(at, step))

    return rows.mapInArrow(run, ddl), int(cells["i_lat"].max()) + 1, int(cells["i_lon"].max()) + 1, [*words, *counted]


def usable_paths(who: np.ndarray, receiver: pa.Array, lon: np.ndarray, lat: np.ndarray, src_lon: np.ndarray, src_lat: np.ndarray, velocity: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, receiver, lon, lat, distance in km, travel time) of the paths that have a distance and a time, those of one receiver at one place by distance and time. They come in the order of row, receiver and place."""
    distance = A.geodesic(src_lon, src_lat, lon, lat)[0]
    with np.errstate(all="ignore"):
        time = distance / velocity
        use = np.flatnonzero((distance > 0) & (time > 0))
    receiver = receiver.take(pa.array(use))
    who, lon, lat, distance, time = (v[use] for v in (who, lon, lat, distance, time))
    if len(use) > 1:
        codes = receiver.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        again = np.concatenate([[False], np.all([v[1:] == v[:-1] for v in (who, codes, lon, lat)], axis=0)])
        if again.any():
            order = np.lexsort((time, distance, np.cumsum(~again)))
            receiver = receiver.take(pa.array(order))
            who, lon, lat, distance, time = (v[order] for v in (who, lon, lat, distance, time))
    return who, receiver, lon, lat, distance, time
