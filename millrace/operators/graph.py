"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        context.setCheckpointDir(folder or "file:///tmp/checkpoints")
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of ``edges`` (a, b): the smallest id that is connected with each.

    Every round takes the smallest label of all neighbours and then that label's own label."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        further = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(spread.join(further, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
