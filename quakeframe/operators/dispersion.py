"""From traces to dispersion curves in one plan: filter bank, peaks, jump repair, phase cycles, cycle shift and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .curves import branch_qc, interpolate_at, select_cycle_shift, unwrap_phase
from .kernels import ftan_arrays, repair_jumps
from .traces import peak_candidates


def dispersion_branches(samples: DataFrame, traces: DataFrame, periods: tuple[float, ...] | None = None, alpha: float = 20.0, velocity: tuple[float, float] = (2.0, 5.0), threshold: float = 50.0, jump_points: int = 3, phase_shift: float = -1.0) -> DataFrame:
    """(trace_id, distance, period, i, time, group_velocity, amplitude, phase, instant_period, snr, replaced, initial_count): the repaired branch of each trace.

    ``traces`` has trace_id, distance and, without ``periods``, each trace's own target ``periods``. Samples are shuffled
    once, to put traces together; after that only the candidates of a trace move.
    """
    bank = ftan_arrays(samples, periods, alpha, traces)
    return repair_jumps(peak_candidates(bank, velocity, phase_shift), threshold, jump_points, keep=("distance",))


def measure_dispersion(branches: DataFrame, reference: DataFrame, cycle: dict | None = None) -> DataFrame:
    """Dispersion table of ``branches``: (trace_id, target_period, period, group_velocity, phase_velocity, amplitude, snr, shift, status, ...).

    The instantaneous period is the abscissa of the curve, and the order of target periods that of the phase fold. One
    whole number of cycles a trace moves all phase velocities nearest to the reference; ``status`` says how sure it is.
    Points without a positive period and velocity are left out.
    """
    ok = branches.filter("instant_period > 0 AND group_velocity > 0").select(F.col("trace_id").alias("curve"), F.col("period").alias("target_period"), F.col("instant_period").alias("period"), "group_velocity", "phase", "amplitude", "snr", "distance", "initial_count", "replaced")
    ok = cut(ok)
    phase = cut(interpolate_at(reference, unwrap_phase(ok, reference, order="target_period").withColumnRenamed("phase_velocity", "velocity")))
    full = ok.join(phase.select("curve", "target_period", F.col("velocity").alias("uncorrected"), "reference"), ["curve", "target_period"])
    shift = select_cycle_shift(full.withColumn("velocity", F.col("uncorrected")), **(cycle or {})).select("curve", "shift", "score", "gap", "status")
    slow = 1 / F.col("uncorrected") + F.col("shift") * F.col("period") / F.col("distance")
    out = full.join(shift, "curve").withColumn("phase_velocity", F.when(F.col("uncorrected") != 0, F.when(slow > 0, 1 / slow)))
    return out.select(F.col("curve").alias("trace_id"), "target_period", "period", "group_velocity", "phase_velocity", "amplitude", "snr", "phase", "distance", "replaced", "initial_count", "reference", "shift", "score", "gap", "status")


def dispersion_qc(table: DataFrame, **limits: float) -> DataFrame:
    """``branch_qc`` of each trace of a dispersion table."""
    named = table.select(F.col("trace_id").alias("curve"), "target_period", F.col("period").alias("instant_period"), F.col("group_velocity").alias("velocity"), "amplitude", "initial_count")
    return branch_qc(named, **limits).withColumnRenamed("curve", "trace_id")
