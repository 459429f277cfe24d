"""Helpers shared by the training-data operators: table access, Arrow maps, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch. Whole texts are kept, so the byte bound is what limits a worker's memory.
BATCH_ROWS = 256
BATCH_BYTES = 4 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, and keep unions from claiming a partitioning.

    Spark 4.1.2 can aggregate above such a union without a shuffle although equal keys lie in different partitions.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only a session in one process may do without that setting."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quakeframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate results as Parquet tables below the shared folder, removed on leaving."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them, and let Spark remove the shuffles that no plan refers to any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage. Spark's cleaner then deletes shuffle files and checkpoints that no plan refers to any more, and no others."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list[Any]]], dict[str, Any]], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to column lists, batch by batch; it returns columns (lists or arrays) in the order of ``schema``."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield record_batch(out, target)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str | T.StructType) -> pa.Schema:
    """The Arrow schema of a DDL string or a StructType."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def record_batch(columns: dict[str, Any], target: pa.Schema) -> pa.RecordBatch:
    """Columns (lists, NumPy or Arrow arrays) as one record batch of the given schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in target], schema=target)


def doc_crc(column: str = "doc_id") -> Any:
    """crc32 of the id written as text, the hash that splits training from held-out documents."""
    return F.crc32(F.col(column).cast("string"))


def row_count_sample(df: DataFrame, key: Any, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of ``key``: the same ones at any partitioning.

    One count fixes a hash threshold that leaves about four times the wanted rows, so the final top-k handles a
    bounded number of rows at every table size.
    """
    n = df.count()
    h = F.xxhash64(key)
    if n > 8 * rows:
        limit = int(-(2**63) + 2**64 * min(1.0, 4 * rows / n))
        df = df.filter(h < F.lit(limit))
    return df.orderBy(h, key).limit(rows)
