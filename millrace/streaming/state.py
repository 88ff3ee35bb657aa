"""Stateful operators on streams: a cache with expiry, pacing, single flight, and windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions import fixed

SERVED = "key string, at double, hit boolean, stale boolean"


def cached(stream: DataFrame, ttl: float = fixed.CACHE_SECONDS, degraded_ttl: float = fixed.DEGRADED_SECONDS, stale_for: float = fixed.STALE_SECONDS, expire: bool = True) -> DataFrame:
    """Answers of a cache per key to requests (key, at seconds, healthy): hit, or a load; was a stale pool at hand?

    A load lives ``ttl`` seconds (``degraded_ttl`` if it was not healthy); the last healthy one stays usable
    as a stale pool for ``stale_for`` seconds.  State is three numbers per key; with ``expire``
    it is dropped when idle (processing time, so for streams that keep running)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        loaded, good, healthy_at = state.get if state.exists else (None, True, None)
        rows = []
        for batch in batches:
            for r in batch.sort_values("at").itertuples():
                hit = loaded is not None and r.at - loaded < (ttl if good else degraded_ttl)
                if not hit:
                    loaded, good = float(r.at), bool(r.healthy)
                    if good:
                        healthy_at = loaded
                stale = not hit and not good and healthy_at is not None and r.at - healthy_at < stale_for
                rows.append((key[0], float(r.at), bool(hit), bool(stale)))
        state.update((loaded, good, healthy_at))
        if expire:
            state.setTimeoutDuration(int(1000 * stale_for))
        yield pd.DataFrame(rows, columns=["key", "at", "hit", "stale"])

    return stream.groupBy("key").applyInPandasWithState(step, SERVED, "loaded double, good boolean, healthy_at double", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def paced(stream: DataFrame, interval: float) -> DataFrame:
    """(key, at, start): requests of a key start at least ``interval`` seconds apart."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        rows = []
        for batch in batches:
            for at in sorted(batch["at"]):
                start = max(at, free)
                free = start + interval
                rows.append((key[0], float(at), float(start)))
        state.update((free,))
        yield pd.DataFrame(rows, columns=["key", "at", "start"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, at double, start double", "free double", "append", GroupStateTimeout.NoTimeout)


def single_flight(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first request of each key within the watermark; others wait for it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests per kind and window of event time; rows later than the watermark are left out.  An extension."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests per user and session.  An extension."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
