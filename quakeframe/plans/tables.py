"""Source and sink projections on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import robust as R
from ..session import cut, scratch
from ..sources import files as S
from .base import Catalog
from .maps import MIN_RAW, STACK_SQL

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES

C.add("s7_event_catalog", "catalog", lambda c: c.orderBy(F.col("magnitude").desc(), "event_id").select("event_id", "origin", "magnitude"), "SELECT event_id, origin, magnitude FROM catalog")


def _s8(d):
    """Rounded on the doubles, as the SQL does: Spark's own round takes the decimal text of a number, where 40.245 is a tie."""
    return S.qc_lines(R.energy_select(d.withColumn("h", F.round(F.col("h") * 100) / 100)))


C.add("s8_qc_table", "hk_results", _s8, "SELECT station, CAST(rf_id AS STRING) AS name, printf('%.4f', round(h, 2)) AS h, printf('%.4f', k) AS k, printf('%.4f', energy) AS energy FROM hk_results QUALIFY energy >= 0.5 * max(energy) OVER (PARTITION BY station)")


# Round trips: each writes its view below the shared folder, reads it again with the library's reader, and removes it.
def _s1(p):
    with scratch(p.sparkSession) as path:
        p.withColumn("distance_km", F.lit(None).cast("double")).select(*[F.col(f.name).cast(f.dataType) for f in S.MEASUREMENTS.fields]).write.parquet(path)
        return cut(S.read_measurements(p.sparkSession, path, [5, 10, 15], 8.0, True).select("source", "receiver", "period_s", F.round("c", 6).alias("c"), F.round("snr", 6).alias("snr")))


C.add("s1_read_measurements", "paths", _s1, "SELECT source, receiver, period_s, round(c, 6) AS c, round(snr, 6) AS snr FROM paths WHERE period_s IN (5, 10, 15) AND snr >= 8 AND amp > 0")


def _s2(c):
    """Curve files with a bad line for each seventh period."""
    line = F.concat_ws(" ", F.format_string("%.1f", "period"), F.format_string("%.4f", "velocity"), F.when(F.col("period") % 7 == 0, F.lit("-1")).otherwise(F.lit("0.05")))
    with scratch(c.sparkSession) as path:
        c.select("curve", line.alias("value")).repartition("curve").write.partitionBy("curve").text(path)
        curves, rejects = S.read_curve_files(c.sparkSession, f"{path}/*/*.txt", "velocity")
        number = F.regexp_extract("file", r"curve=(\d+)", 1).cast("long").alias("curve")
        bad = rejects.select(number, F.split("line", " ")[0].cast("double").alias("period"), F.lit(None).cast("double").alias("velocity"), F.lit(None).cast("double").alias("sigma"))
        return cut(curves.select(number, "period", "velocity", "sigma").unionByName(bad))


C.add("s2_read_curve_files", "curves", _s2, "SELECT curve, period, CASE WHEN period % 7 <> 0 THEN round(velocity, 4) END AS velocity, CASE WHEN period % 7 <> 0 THEN 0.05::DOUBLE END AS sigma FROM curves")


def _s3(c):
    rows = c.select(F.col("curve").alias("trace_id"), F.col("period").alias("target_period"), (F.col("period") * 1.01).alias("period"), F.col("velocity").alias("group_velocity"), (F.col("velocity") + 0.5).alias("phase_velocity"), F.lit(0.5).alias("amplitude"), F.col("amplitude").alias("snr"))
    with scratch(c.sparkSession) as path:
        S.write_dispersion(rows, path)
        got = S.read_dispersion_files(c.sparkSession, f"{path}/*/*.txt")
        return cut(got.select(F.regexp_extract("file", r"trace_id=(\d+)", 1).cast("long").alias("trace_id"), "target_period", "period", "group_velocity", "phase_velocity", "amplitude", "snr"))


C.add("s3_read_dispersion_files", "curves", _s3, "SELECT curve AS trace_id, period AS target_period, round(period * 1.01, 6) AS period, round(velocity, 4) AS group_velocity, round(velocity + 0.5, 4) AS phase_velocity, 0.5::DOUBLE AS amplitude, round(CAST(amplitude AS DOUBLE), 3) AS snr FROM curves")


def _s3_long(c):
    """The long form with header lines; every fifth curve has no distance."""
    rows = c.select(
        F.col("curve").alias("trace_id"), F.col("period").alias("target_period"), (F.col("period") * 1.01).alias("period"), F.col("velocity").alias("group_velocity"), F.lit(None).cast("double").alias("phase_velocity"), F.lit(0.5).alias("amplitude"),
        (F.col("period") / 8).alias("phase_derivative"), (F.col("period") / 16).alias("hilbert_phase_derivative"), (F.col("period") * 1.02).alias("hilbert_period"), F.col("amplitude").alias("snr"),
        F.when(F.col("curve") % 5 != 0, F.col("curve") * 10).alias("distance_km"), F.lit("ZZ").alias("component"),
    )
    with scratch(c.sparkSession) as path:
        S.write_dispersion(rows, path, debug=True, decibel=True, header=("component", "distance_km"))
        got = S.read_dispersion_files(c.sparkSession, f"{path}/*/*.txt")
        number = F.regexp_extract("file", r"trace_id=(\d+)", 1).cast("long").alias("trace_id")
        return cut(got.select(number, "target_period", "phase_velocity", "phase_derivative", "hilbert_phase_derivative", "hilbert_period", "period_delta", "snr", "decibel", F.col("header.component").alias("component"), F.col("header.distance_km").cast("double").alias("distance_km")))


C.add("s3_dispersion_long_form", "curves", _s3_long, "SELECT curve AS trace_id, period AS target_period, CAST(NULL AS DOUBLE) AS phase_velocity, round(period / 8, 6) AS phase_derivative, round(period / 16, 6) AS hilbert_phase_derivative, round(period * 1.02, 4) AS hilbert_period, round(period * 1.02 - period * 1.01, 6) AS period_delta, round(CAST(amplitude AS DOUBLE), 3) AS snr, true AS decibel, 'ZZ' AS component, CASE WHEN curve % 5 <> 0 THEN curve * 10.0::DOUBLE END AS distance_km FROM curves")


def _s4(e):
    """Fields written twice: the periods of the second write replace those of the first."""
    with scratch(e.sparkSession) as path:
        S.write_event_fields(e, path, provenance={"run": "first"})
        S.write_event_fields(e.filter("period_s <= 10"), path, overwrite=True, provenance={"run": "second"})
        return cut(e.sparkSession.read.parquet(path).select("period_s", "cell", "source", F.round("slowness", 6).alias("slowness"), "reason", "run"))


C.add("s4_write_event_fields", "event_cells", _s4, "SELECT period_s, cell, source, round(slowness, 6) AS slowness, reason, CASE WHEN period_s <= 10 THEN 'second' ELSE 'first' END AS run FROM event_cells")


def _s5(e):
    with scratch(e.sparkSession) as path:
        S.write_event_fields(e, path)
        return cut(S.restack_from_fields(e.sparkSession, path, [5, 15, 25], min_raw_measurements_per_cell=MIN_RAW).select("period_s", "cell", F.round("velocity", 6).alias("velocity"), "raw_count"))


C.add("s5_restack_from_fields", "event_cells", _s5, f"SELECT period_s, cell, round(1 / slow, 6) AS velocity, raw_count FROM ({STACK_SQL.replace('max(ms) AS slowness', 'max(ms) AS slow')}) WHERE period_s IN (5, 15, 25)")
