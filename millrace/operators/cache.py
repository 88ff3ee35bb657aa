"""Caches, pacing and backoff over event tables (the batch forms; see ``streaming`` for the stateful ones)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed


def paced(df: DataFrame, key: str, at: str, interval: float) -> DataFrame:
    """(key, requested, started): requests of a key start at least ``interval`` seconds apart, in order.

    start(i) = max(at(i), start(i - 1) + interval) = i * interval + max over j <= i of (at(j) - j * interval):
    a running maximum, so no fold over collected events is needed."""
    w = Window.partitionBy(key).orderBy(at)
    k = (F.row_number().over(w) - 1) * F.lit(float(interval))
    numbered = df.select(key, F.col(at).alias("requested"), k.alias("__k"))
    run = F.max(F.col("requested") - F.col("__k")).over(Window.partitionBy(key).orderBy("requested", "__k").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("started", F.col("__k") + run).drop("__k")


def served(df: DataFrame, key: str, at: str, ttl: float) -> DataFrame:
    """(key, at, hit): would a cache of ``ttl`` seconds, counted from each load, answer the request?

    Which request loads depends on the one before, so the requests of a key are gone through in order: sorted
    partitions stream by, and one number is held at a time, however many requests a key has.  Requests without a
    time come first and load nothing; repeated requests are rows of their own."""
    rows = df.select(F.col(key), F.col(at).cast("double").alias("at"))
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, load = None, False, None
        for batch in batches:
            hits = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or k != now:
                    now, begun, load = k, True, None
                hit = t is not None and load is not None and t - load < ttl
                if t is not None and not hit:
                    load = t
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [key, "at", "hit"])

    return ordered.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, at double, hit boolean")


def last_healthy(df: DataFrame, key: str, at: str, healthy: str, window: float = fixed.STALE_SECONDS) -> DataFrame:
    """Adds ``stale_at``: when the last healthy load of at most ``window`` seconds before was made (an as-of join)."""
    w = Window.partitionBy(key).orderBy(F.col(at)).rangeBetween(-int(window), -1)
    return df.withColumn("stale_at", F.max(F.when(F.col(healthy), F.col(at))).over(w))


def retained(df: DataFrame, at: str, entries: int = fixed.CACHE_ENTRIES, most_bytes: int = fixed.PAGE_BYTES, body: str | None = None) -> DataFrame:
    """Entries that a bounded cache keeps: the newest ones, without null or oversized bodies."""
    if body is not None:
        df = df.where(F.octet_length(body) <= most_bytes)
    return df.orderBy(F.desc(at)).limit(entries)


def blocked(df: DataFrame, key: str, at: str, backoff: str) -> DataFrame:
    """Adds ``blocked``: did an earlier answer's backoff (seconds) still run at the time of a request?"""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("blocked", F.coalesce(F.max(F.col(at) + F.coalesce(F.col(backoff), F.lit(0))).over(w) > F.col(at), F.lit(False)))


def single_flight(df: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """One load for requests of a key in the same window of time: (key, slot, first request, waiting)."""
    slot = F.floor(F.col(at) / seconds)
    return df.groupBy(key, slot.alias("slot")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("waiting"))
