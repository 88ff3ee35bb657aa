"""Shared helpers: the shared folder, materialised tables, running totals, label joins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of rows of a narrow (key, value) side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows and bytes of an Arrow batch handed to Python: documents are wide, so batches are short.
BATCH_ROWS, BATCH_BYTES = "512", "4m"


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for executors with little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a local session may go without that setting; it then uses a folder of its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks under ``key``; one thing at a time, so that stages that
    follow each other in the same worker do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what earlier stages have kept in this worker."""
    _held.clear()


def trim() -> None:
    """Give memory that is free inside this worker back to the system."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def tidy(run):
    """``run``, a function over Arrow batches, that trims its worker's memory when it ends: workers are reused,
    and what a stage leaves in them counts for the ones after it."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(path: str):
    """(pyarrow file system, path in it) for files that Python workers write and read in the shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_total(df: DataFrame, order: Sequence, value: str, out: str, name: str, extra: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that come before, in ascending ``order``.

    Rows are range-partitioned by ``order`` and written once with their partition number; partition
    totals (one row each) give the offsets.  No task sees more than its own range, whatever the keys.
    ``extra`` columns only break ties inside a range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = materialize(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), name)
    totals = parts.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*keys, *extra).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__in") + F.col("__offset"))
        .drop("__part", "__in", "__offset")
    )


def held_out(doc_id) -> Column:
    """True for the documents that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))
