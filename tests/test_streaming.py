"""Stateful operators on small file streams, against their batch forms."""

from pyspark.sql import functions as F

from millrace.operators import cache
from millrace.streaming import state


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_cache_and_pacing(spark, tmp_path):
    rows = [(k, float(t), t % 3 > 0) for k in "ab" for t in (0, 5, 700, 705, 1400, 1401)]
    df = spark.createDataFrame(rows, "key string, at double, healthy boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(state.cached(stream, ttl=600, degraded_ttl=600, expire=False), "cached")
    got = {(r.key, r.at): r.hit for r in spark.table("cached").collect()}
    want = {(r.key, r.at): r.hit for r in cache.served(df, "key", "at", 600).collect()}
    assert got == want
    run(state.paced(stream, 10), "paced")
    got = sorted((r.key, r.at, r.start) for r in spark.table("paced").collect())
    want = sorted((r.key, r.requested, r.started) for r in cache.paced(df, "key", "at", 10).collect())
    assert got == want


def test_windows(spark, tmp_path):
    events = spark.range(100).select((F.timestamp_seconds(F.col("id") * 120 + 7200)).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.lit(1.0).alias("value"), F.col("id").cast("string").alias("key"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(state.windowed(stream), "windowed")
    closed = {(r.window.start, r.event_type): r.n for r in spark.table("windowed").collect()}
    every = {(r.window.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert closed and all(every[k] == n for k, n in closed.items())
    run(state.single_flight(stream), "single")
    assert spark.table("single").count() == 100
