"""Row-local operators on streams of measurements.

Filters and scalar functions have no blocking step, so they run unchanged on a streaming DataFrame; new files of a
folder pass through them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import geodesic, travel_time
from ..operators.masks import valid_measurements
from ..sources.files import MEASUREMENTS


def measurement_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder as a stream of measurements."""
    return spark.readStream.schema(MEASUREMENTS).parquet(folder)


def with_travel_times(paths: DataFrame, min_snr: float | None = None) -> DataFrame:
    """Valid measurements with their distance and travel time; the same for batches and streams."""
    d = geodesic(F.col("src_lon"), F.col("src_lat"), F.col("rcv_lon"), F.col("rcv_lat"))["distance_km"]
    return valid_measurements(paths, min_snr).withColumn("distance_km", d).withColumn("travel_time", travel_time(F.col("distance_km"), F.col("c")))


def write_travel_times(spark: SparkSession, folder: str, out: str, checkpoint: str, min_snr: float | None = None) -> StreamingQuery:
    """Start a query that appends what has arrived to ``out`` by period and stops."""
    stream = with_travel_times(measurement_stream(spark, folder), min_snr)
    return stream.writeStream.partitionBy("period_s").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
