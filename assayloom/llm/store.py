"""Where intermediate tables live, and how they are written."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session. Where that is unset, a temporary one with a local master
    (tests), and an error on a cluster, whose executors would each write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="assayloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/assayloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_forgiving_drop, spark, path)
    return path


def _forgiving_drop(spark: SparkSession, path: str) -> None:
    try:
        _drop(spark, path)
    except Exception:  # the gateway may already be down; the folder is a scratch one
        pass


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of (long) keys is broadcast; 500,000 keys take about 16 MB as a hashed relation.
BROADCAST_ROWS = 500_000


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df (a written table of narrow rows) with a broadcast hint if its counted size is under BROADCAST_ROWS, else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Bytes of an Arrow batch on its way to a Python worker, at most: two workers and a full heap share an executor's memory. Operators that
#: cut batches into slices anyway take small ones: a batch is held several times, outside the heap and in the worker.
BATCH_BYTES, SMALL_BATCH_BYTES = 16 << 20, 4 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers the session's limit of bytes per Arrow batch to most, if it is higher; long texts make few rows large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > most or int(spark.conf.get(key).rstrip("bB")) <= 0:
        spark.conf.set(key, str(most))
