"""Sources and sinks: measurement tables, text curves, dispersion tables, catalogues, fields and QC tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASUREMENTS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("component", T.StringType()), ("source", T.StringType()), ("receiver", T.StringType()), ("src_lon", T.DoubleType()), ("src_lat", T.DoubleType()),
        ("rcv_lon", T.DoubleType()), ("rcv_lat", T.DoubleType()), ("period_s", T.IntegerType()), ("c", T.DoubleType()), ("snr", T.DoubleType()), ("valid", T.BooleanType()), ("amp", T.DoubleType()), ("distance_km", T.DoubleType()),
    )]
)
CATALOG = T.StructType([T.StructField(n, t) for n, t in (("time", T.StringType()), ("latitude", T.DoubleType()), ("longitude", T.DoubleType()), ("depth", T.DoubleType()), ("magnitude", T.DoubleType()))])


def _no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, once, at the scan."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_measurements(spark: SparkSession, path: str, periods: Sequence[int] | None = None, min_snr: float | None = None, require_amplitude: bool = False) -> DataFrame:
    """Measurements of the wanted periods, filters pushed to the scan. A wanted period without any row is an error."""
    df = spark.read.schema(MEASUREMENTS).parquet(path)
    if periods is not None:
        df = df.filter(F.col("period_s").isin(*periods))
        want = spark.createDataFrame([(int(p),) for p in periods], "period_s int")
        absent = [r[0] for r in want.join(df.select("period_s").distinct(), "period_s", "left_anti").collect()]
        if absent:
            raise ValueError(f"periods without measurements: {sorted(absent)}")
    df = _no_nan(df)
    if require_amplitude:
        df = df.filter("amp > 0")
    return df if min_snr is None else df.filter(F.col("snr") >= min_snr)


def _lines(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))


def read_curve_files(spark: SparkSession, glob: str, value_name: str = "value") -> tuple[DataFrame, DataFrame]:
    """(curves, rejects) of whitespace files ``period value sigma`` with # comments: exactly three finite columns, period and sigma positive."""
    rows = _lines(spark, glob).filter("line <> '' AND line NOT LIKE '#%'").withColumn("p", F.split("line", r"\s+"))
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    d = rows.withColumns({"period": number(0), value_name: number(1), "sigma": number(2)})
    good = F.size("p") == 3
    for c in ("period", value_name, "sigma"):
        good &= F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    good &= (F.col("period") > 0) & (F.col("sigma") > 0)
    d = d.withColumn("good", F.coalesce(good, F.lit(False)))
    curves = d.filter("good").select("file", "period", value_name, "sigma").sortWithinPartitions("file", "period")
    return curves, d.filter("NOT good").select("file", "line")


# Own name, name in the file and decimals of the columns of a dispersion table. DEBUG stands before the last
# column in the long form; the last one is named snr or snr_db.
DISPERSION = (
    ("target_period", "target_period_s", "%.6f"),
    ("period", "instant_period_s", "%.6f"),
    ("group_velocity", "group_velocity_km_s", "%.4f"),
    ("phase_velocity", "phase_velocity_km_s", "%.4f"),
    ("amplitude", "amplitude", "%.6e"),
)
DEBUG = (
    ("phase_derivative", "phase_derivative_rad_s", "%.6f"),
    ("hilbert_phase_derivative", "hilbert_phase_derivative_rad_s", "%.6f"),
    ("hilbert_period", "hilbert_instant_period_s", "%.4f"),
    ("period_delta", "instant_period_delta_s", "%.6f"),
)
SNR = ("snr", "snr", "%.3f")


def read_dispersion_files(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of 6- or 10-column dispersion tables with their file's ``# key: value`` lines as a map, of equal keys the last.

    A file, the table of one trace, is one row until its lines are parsed, so nothing is shuffled. ``snr`` is the last
    column of either form, in dB if the header names snr_db. What is no number is NULL.
    """
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)).alias("lines"))
    marked = F.filter("lines", lambda x: x.startswith("#"))
    pairs = F.transform(F.filter(marked, lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^#\s*([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^#[^:]*:(.*)$", 1)).alias("v")))
    # Later pairs win: of each key the last is kept.
    names = F.array_distinct(F.transform("pairs", lambda e: e["k"]))
    header = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter("pairs", lambda e: e["k"] == k), -1)["v"]))
    decibel = F.when(F.exists(marked, lambda x: x.contains("snr")), F.exists(marked, lambda x: x.contains("snr_db")))

    def number(p: Column, i: int) -> Column:
        x = F.get(p, F.lit(i)).try_cast("double")
        return F.when(~F.isnan(x), x)

    def row(p: Column) -> Column:
        short, long = len(DISPERSION), len(DISPERSION) + len(DEBUG)
        wide = F.size(p) > long
        main = [number(p, i).alias(c) for i, (c, _, _) in enumerate(DISPERSION)]
        extra = [F.when(wide, number(p, short + i)).alias(c) for i, (c, _, _) in enumerate(DEBUG)]
        return F.struct(F.lit(True).alias("there"), *main, F.when(wide, number(p, long)).otherwise(number(p, short)).alias("snr"), *extra)

    data = F.transform(F.filter("lines", lambda x: (x != "") & ~x.startswith("#")), lambda x: row(F.split(x, r"\s+")))
    d = files.withColumn("pairs", pairs).select("file", F.when(F.size("pairs") > 0, header).alias("header"), decibel.alias("decibel"), data.alias("data"))
    # The outer form and a filter behind it: the plain form has the optimiser parse every file a second time for its size.
    return d.select("file", F.inline_outer("data"), "header", "decibel").filter("there").drop("there")


def dispersion_texts(df: DataFrame, debug: bool = False, decibel: bool = False, header: Sequence[str] = ()) -> DataFrame:
    """(trace_id, value): the text of each trace's table, its ``# key: value`` lines first, periods ascending.

    ``header`` names columns of ``df`` that hold one value a trace; NULLs are left out. ``debug`` adds the four columns of
    the long form, in which ``period_delta`` is made from the periods. A trace's table is bounded by its periods.
    """
    d = df.withColumn("period_delta", F.col("hilbert_period") - F.col("period")) if debug else df
    columns = (*DISPERSION, *(DEBUG if debug else ()), SNR)
    line = F.format_string("    ".join(f for _, _, f in columns), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c, _, _ in columns])
    rows = d.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("target_period", line.alias("line")))).alias("rows"), *[F.first(c, True).alias(f"h_{c}") for c in header])
    heads = [F.when(F.col(f"h_{c}").isNotNull(), F.concat(F.lit(f"# {c}: "), F.col(f"h_{c}").cast("string"))) for c in header]
    names = [n for _, n, _ in columns[:-1]] + ["snr_db" if decibel else "snr"]
    return rows.select("trace_id", F.concat_ws("\n", *heads, F.lit("# " + " ".join(names)), F.transform("rows", lambda r: r["line"])).alias("value"))


def write_dispersion(df: DataFrame, path: str, mode: str = "errorifexists", debug: bool = False, decibel: bool = False, header: Sequence[str] = ()) -> None:
    """The tables of ``dispersion_texts``, one folder and file a trace."""
    dispersion_texts(df, debug, decibel, header).write.partitionBy("trace_id").mode(mode).text(path)


def write_event_fields(df: DataFrame, path: str, overwrite: bool = False, provenance: dict[str, str] | None = None) -> None:
    """Fields partitioned by period. Without ``overwrite`` an existing target is an error; with it only the periods in ``df`` are replaced."""
    out = df.withColumns({k: F.lit(v) for k, v in (provenance or {}).items()})
    w = out.write.partitionBy("period_s")
    if overwrite:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        w.mode("errorifexists").parquet(path)


def restack_from_fields(spark: SparkSession, path: str, periods: Sequence[int], helmholtz: bool = False, **config: object) -> DataFrame:
    """The stack from stored fields alone: pruned to the wanted periods, an error if one or the amplitude columns are missing."""
    from ..operators.stack import eikonal_vs_helmholtz, stack_cells

    df = spark.read.parquet(path)
    if helmholtz and not {"helmholtz_slowness", "helmholtz_reason"} <= set(df.columns):
        raise ValueError("the stored fields lack the amplitude family")
    df = df.filter(F.col("period_s").isin(*periods))
    have = {r[0] for r in df.select("period_s").distinct().collect()}
    if set(periods) - have:
        raise ValueError(f"periods without stored fields: {sorted(set(periods) - have)}")
    return (eikonal_vs_helmholtz if helmholtz else stack_cells)(df, **config)  # type: ignore[operator]


def read_event_catalog(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Earthquakes with parsed times, by descending magnitude."""
    df = spark.read.schema(CATALOG).csv(path, header=header)
    return df.withColumn("time", F.to_timestamp("time")).orderBy(F.col("magnitude").desc_nulls_last(), "time")


def qc_lines(df: DataFrame) -> DataFrame:
    """Kept results as (station, name, h, k, energy) with four decimals."""
    four: list[Column] = [F.format_string("%.4f", F.col(c).cast("double")).alias(c) for c in ("h", "k", "energy")]
    return df.filter("kept").select("station", F.col("rf_id").cast("string").alias("name"), *four)


def write_qc_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The kept results as CSV, partitioned by station."""
    qc_lines(df).write.partitionBy("station").mode(mode).csv(path, header=True)
