"""Fair shares of a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text


def shares(df: DataFrame, key: str, length: str, order: str, budget: int) -> DataFrame:
    """Adds ``share``: what is short is kept whole, the rest share evenly; a remainder goes to the earliest.

    Sorted by length, row k of n is whole while its length is at most (budget - lengths before) / (n - k)."""
    by = Window.partitionBy(key).orderBy(length, order)
    before = F.coalesce(F.sum(length).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    k = F.row_number().over(by) - 1
    even = F.floor((F.lit(budget) - before) / (n - k))
    out = df.withColumn("__whole", F.col(length) <= even)
    # Once a row is cut all longer ones are.
    out = out.withColumn("__whole", F.min(F.col("__whole").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    w = Window.partitionBy(key)
    used = F.coalesce(F.sum(F.when(F.col("__whole"), F.col(length))).over(w), F.lit(0))
    out = out.withColumn("__left", F.lit(budget) - used).withColumn("__cut", F.sum((~F.col("__whole")).cast("int")).over(w))
    rank = F.row_number().over(Window.partitionBy(key, "__whole").orderBy(order)) - 1
    share = F.floor(F.col("__left") / F.greatest("__cut", F.lit(1))) + (rank < F.col("__left") % F.greatest("__cut", F.lit(1))).cast("int")
    return out.withColumn("share", F.when(F.col("__whole"), F.col(length)).otherwise(share).cast("long")).drop("__whole", "__left", "__cut")


def allocate(df: DataFrame, key: str, content: str, order: str, budget: int) -> DataFrame:
    """Contents fitted into the budget of their key; empty ones are dropped; ``truncated`` where some is cut."""
    sized = df.withColumn("__n", F.length(content)).where("__n > 0")
    out = shares(sized, key, "__n", order, budget)
    cut = F.col("share") < F.col("__n")
    prior = F.col("truncated") if "truncated" in df.columns else F.lit(False)
    return out.withColumn("truncated", prior | cut).withColumn(content, text.fit(F.col(content), F.col("share"))).where(F.length(content) > 0).drop("__n")
