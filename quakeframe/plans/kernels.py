"""Kernel jobs on the driver's tables. Most have no SQL form; tests hold them against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import with_geodesic
from ..operators import dispersion as D
from ..operators import grid as G
from ..operators import kernels as K
from ..operators import traces as T
from ..operators.fields import distance_km
from ..session import cut
from .base import Catalog

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES
PERIODS = (1.5, 2.0, 3.0, 4.0, 6.0)


def _rounded(df, n=6):
    return df.select(*[(F.round(c, n) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in df.dtypes])


def _shifted(s):
    """The samples 11 s after the start of their axis, and a trace's distance."""
    return s.select("trace_id", "i", (F.col("t") + 6).alias("t"), "v"), s.select("trace_id").distinct().withColumn("distance", F.lit(40.0))


def _picks(s):
    rows, distance = _shifted(s)
    return T.best_candidates(T.peak_candidates(K.ftan_arrays(rows, PERIODS, traces=distance)))


C.add("k1_ftan", "samples", lambda s: _rounded(K.ftan(s, PERIODS)))


def _stepped(s):
    """A bank whose envelope is the samples' size in steps of a quarter (so there are plateaus), with the samples as phase."""
    bank = s.select("trace_id", F.lit(2.0).alias("period"), "i", (F.col("t") + 6).alias("t"), (F.floor(F.abs("v") * 40) / 4).alias("envelope"), F.col("v").alias("phase"))
    return T.bank_arrays(bank).withColumn("distance", F.lit(40.0))


def _w11(s):
    return _rounded(T.best_candidates(T.peak_candidates(_stepped(s))).drop("phase", "snr")).withColumn("i", F.col("i").cast("long"))


def _w11_all(s):
    found = T.peak_candidates(_stepped(s)).select("trace_id", "best", F.posexplode_outer("candidates").alias("j", "c"))
    return _rounded(found.select("trace_id", "c.*", (F.col("j") == F.col("best")).alias("best"))).withColumn("i", F.col("i").cast("long"))


_UNWRAP = "{x} - 2 * pi() * round_even(({x} - {base} - 0.5 * pi()) / (2 * pi()), 0)"
_PEAKS = f"""WITH b AS (SELECT trace_id, i, t + 6 AS t, floor(abs(v) * 40) / 4 AS e, v AS ph FROM samples), n AS (SELECT *, lag(e) OVER w AS l, lead(e) OVER w AS r, lag(ph) OVER w AS pl, lead(ph) OVER w AS pr, max(i) OVER (PARTITION BY trace_id) AS z FROM b WINDOW w AS (PARTITION BY trace_id ORDER BY i)),
u AS (SELECT *, sum(CASE WHEN e = l THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY i) AS run FROM n), q AS (SELECT trace_id, run, min(i) AS i0, max(i) AS i1, any_value(e) AS e FROM u GROUP BY trace_id, run), p AS (SELECT trace_id, (i0 + i1) // 2 AS i FROM q QUALIFY lag(e) OVER (PARTITION BY trace_id ORDER BY run) < e AND lead(e) OVER (PARTITION BY trace_id ORDER BY run) < e),
f AS (SELECT trace_id, CASE WHEN i = 0 OR i = z THEN least(greatest(1, (z + 1) // 2), z - 1) ELSE i END AS i FROM n WHERE trace_id NOT IN (SELECT trace_id FROM p) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN t BETWEEN 40 / 5.0 AND 40 / 2.0 THEN 1 ELSE 0 END DESC, e DESC, i) = 1),
a AS (SELECT trace_id, i FROM p UNION ALL SELECT trace_id, i FROM f), k AS (SELECT *, coalesce(lag(i) OVER w, 0) AS lo, lead(i) OVER w AS hi FROM a WINDOW w AS (PARTITION BY trace_id ORDER BY i)),
m AS (SELECT k.trace_id, k.i, min(CASE WHEN n.i <= k.i THEN n.e END) * min(CASE WHEN n.i >= k.i THEN n.e END) AS low FROM k JOIN n ON n.trace_id = k.trace_id AND n.i >= k.lo AND n.i <= coalesce(k.hi, n.z) GROUP BY k.trace_id, k.i),
x AS (SELECT n.*, low FROM n JOIN m ON m.trace_id = n.trace_id AND m.i = n.i),
y AS (SELECT *, CASE WHEN l + r - 2 * e = 0 THEN 0 ELSE (l - r) / (l + r - 2 * e) / 2 END AS o, {_UNWRAP.format(x='ph', base='pl')} AS pm FROM x), w AS (SELECT *, {_UNWRAP.format(x='pr', base='pm')} AS prr FROM y), d AS (SELECT *, t + o * 0.5 AS time, o * (pl + prr - 2 * pm) + (prr - pl) / 2 AS dp, e - (l - r) * o / 4 AS amp FROM w),
g AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY time <> 0 DESC, amp DESC, i) = 1 AS best FROM d)
"""
_PEAK = "round(time, 6) AS time, CASE WHEN time <> 0 THEN round(40 / time, 6) END AS group_velocity, round(amp, 6) AS amplitude, CASE WHEN dp <> 0 THEN round(2 * pi() * 0.5 / dp, 6) END AS instant_period"
C.add("w11_pick_peaks", "samples", _w11, f"{_PEAKS}SELECT trace_id, 2.0::DOUBLE AS period, i, {_PEAK} FROM g WHERE best")
C.add("w11_peak_candidates", "samples", _w11_all, f"{_PEAKS}SELECT trace_id, i, {_PEAK}, round(pm + o * (prr - pl) / 2 + o * o * (pl + prr - 2 * pm) / 2, 6) AS phase, round(CASE WHEN low > 0 AND e > 0 THEN e / sqrt(low) ELSE 3.0 END, 6) AS snr, best FROM g")


def _branches(s):
    return _picks(s).select("trace_id", F.col("instant_period").alias("period"), "group_velocity", F.lit(40.0).alias("distance"))


C.add("k2_phase_matched_filter", "samples", lambda s: _rounded(K.phase_matched_filter(s, _branches(s))))
C.add("k2_second_pass", "samples", lambda s: _rounded(K.second_pass(s, cut(_picks(s)), s.select("trace_id").distinct().withColumn("distance", F.lit(40.0)), 1.0, 10.0, 5)))
def _repaired(s):
    rows, distance = _shifted(s)
    return D.dispersion_branches(rows, distance, tuple(1.5 * 1.08**k for k in range(16)), threshold=20.0, jump_points=4)


C.add("w7_repair_jumps", "samples", lambda s: _rounded(_repaired(s)))
C.add("k1_dispersion", "samples ref_curve", lambda s, r: _rounded(D.measure_dispersion(cut(_repaired(s)), r)))


def _points(p):
    d = p.filter("valid").withColumn("distance_km", distance_km("src_lon", "src_lat", "rcv_lon", "rcv_lat"))
    return d.withColumn("travel_time", F.col("distance_km") / F.col("c"))


def _staged(p):
    """The same with the staged distance: seeds whose residuals tie but for rounding are told apart by its last digit."""
    d = with_geodesic(p.filter("valid"), "src_lon", "src_lat", "rcv_lon", "rcv_lat").withColumn("distance_km", F.col("g.distance_km")).drop("g")
    return d.withColumn("travel_time", F.col("distance_km") / F.col("c"))


C.add("w10_correct_cycle_skips", "paths", lambda p: _rounded(K.correct_cycle_skips(_staged(p))))


def _grid(p):
    return G.grid_axes(p.sparkSession, (-10.0, 10.0, 1.0), (40.0, 50.0, 1.0))


C.add("k3_grid_travel_times", "paths", lambda p: _rounded(K.grid_travel_times(_points(p), _grid(p)), 3))
C.add("k3_local_travel_times", "paths", lambda p: _rounded(K.grid_travel_times(_points(p), _grid(p), neighbours=12, tiles=2), 3))
_FIELDS = {"coverage": {"mode": "either", "nearby_km": 150.0, "quadrant_km": 250.0}, "cycle_skips": {"max_residual": 20.0}, "max_laplacian": 1.0}


def _k5(p):
    d = K.event_fields(p, _grid(p), **_FIELDS, columns=("i_lat", "i_lon", "slowness", "reason", "helmholtz_reason"), written=False)
    code = [F.col(c).cast("int").alias(c) for c in ("reason", "helmholtz_reason")]
    return _rounded(d.select("period_s", "source", "i_lat", "i_lon", "slowness", *code, "accepted", "helmholtz_accepted", "n_input", "n_used", "n_amplitude", "n_corrected", "n_rejected"), 3)


def _maps(p):
    """From measurements to both maps; the amplitudes of these paths are rough, so their limit is wide."""
    d = K.event_maps(p, _grid(p), {"min_raw_measurements_per_cell": 3}, **_FIELDS, velocity=(0.5, 10.0), min_fraction=0.01, amplitude={"max_relative_difference": 2.0, "reference_velocity": 0.5})
    return _rounded(d, 3)


C.add("k5_event_fields", "paths", _k5)
C.add("a1_measurements_to_maps", "paths", _maps)
