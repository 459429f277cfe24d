"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(spark: SparkSession) -> None:
    """Keep unions from claiming a partitioning.

    Spark 4.1.2 can aggregate above a union without a shuffle although equal keys lie in different partitions, which
    loses groups. The setting only turns that shortcut off. Arrow batches are bounded in bytes, since rows may hold arrays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Rows of the largest table for one partition of a shuffle.
DEAL = 250_000


def deal(spark: SparkSession, rows: int) -> None:
    """Shuffles of tables of so many rows begin with partitions in proportion, so a task's share does not grow with the table.

    Adaptive execution puts small partitions together again, up to 8 MB, since rows of a few numbers take some bytes in a shuffle and a hundred in memory. Small tables keep the session's number.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows // DEAL > usual
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(min(10_000, rows // DEAL) if own else usual))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m" if own else "64m")


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
    """``df`` written to the checkpoint folder that all executors share, for results that several later steps read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one, removed on leaving."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows; a larger one is left to the optimiser."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
