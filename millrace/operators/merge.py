"""Positional merges of ranked lists: each list has query_id and a 0-based pos; so has every result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed


def renumbered(df: DataFrame, *order: Column) -> DataFrame:
    """New positions from an order within each query."""
    return df.withColumn("__new", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).drop("pos").withColumnRenamed("__new", "pos")


def limited(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("pos") < n)


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """left 0, right 0, left 1, right 1, ...; the rest of the longer list follows."""
    return renumbered(side_by_side(left, right), F.col("pos"), F.col("side")).drop("side")


def concatenate(left: DataFrame, right: DataFrame) -> DataFrame:
    return renumbered(side_by_side(left, right), F.col("side"), F.col("pos")).drop("side")


def source_merge(primary: DataFrame, supplement: DataFrame, from_source: Column) -> DataFrame:
    """Rows of the named source (supplement first), interleaved with the other primary rows; other supplements go."""
    first = concatenate(supplement.where(from_source), primary.where(from_source))
    rest = renumbered(primary.where(~F.coalesce(from_source, F.lit(False))), F.col("pos"))
    return interleave(first, rest)


def local_merge(primary: DataFrame, local: DataFrame, first: int = fixed.SIDE_POSITION) -> DataFrame:
    """The first local rows, then the primary ones, then the other local rows."""
    rank = F.when(F.col("side") == 0, 1).when(F.col("pos") < first, 0).otherwise(2)
    return renumbered(side_by_side(primary, local), rank, F.col("pos")).drop("side")


def manifestation_merge(primary: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` has coverage, terms, pdf, html, doi: the best covered rows, by form, four at most if well covered."""
    w = Window.partitionBy("query_id")
    form = 4 * F.col("pdf").cast("int") + 2 * F.col("html").cast("int") + F.col("doi").cast("int")
    best = found.withColumn("__best", F.max("coverage").over(w)).where("coverage = __best")
    best = renumbered(best, F.desc(form), F.col("pos"))
    many = (F.col("coverage") >= 4) & (F.col("coverage") * 3 >= F.col("terms") * 2)
    kept = best.where(F.col("pos") < F.when(many, 4).otherwise(1)).drop("__best", "coverage", "terms", "pdf", "html", "doi")
    return interleave(kept, primary)


def side_insert(primary: DataFrame, side: DataFrame, limit: int, at: int = fixed.SIDE_POSITION) -> DataFrame:
    """Side rows whose URL key and title key are new go in after position ``at``.

    A side row that comes second to another with its URL key is dropped, whether or not that one stayed."""
    w = lambda k: Window.partitionBy("query_id", k).orderBy("pos")
    fresh = side.join(primary.select("query_id", "url_key").distinct(), ["query_id", "url_key"], "left_anti")
    fresh = fresh.withColumn("__u", F.row_number().over(w("url_key"))).where("__u = 1")
    fresh = fresh.join(primary.select("query_id", "title_key").distinct(), ["query_id", "title_key"], "left_anti")
    fresh = fresh.withColumn("__t", F.row_number().over(w("title_key"))).where("__t = 1").drop("__u", "__t")
    rank = F.when(F.col("side") == 1, 1).when(F.col("pos") < at, 0).otherwise(2)
    return limited(renumbered(side_by_side(primary, fresh.select(*primary.columns)), rank, F.col("pos")).drop("side"), limit)


def pool(primary: DataFrame, side: DataFrame, healthy: DataFrame, limit: int) -> DataFrame:
    """Primary and side rows of each query with ``healthy``: where the primary scan failed, side rows alone, not healthy."""
    ok = healthy.where("healthy").select("query_id")
    merged = side_insert(primary.join(ok, "query_id", "left_semi"), side.join(ok, "query_id", "left_semi"), limit)
    alone = limited(side.join(ok, "query_id", "left_anti"), limit).select(*merged.columns)
    return merged.withColumn("healthy", F.lit(True)).unionByName(alone.withColumn("healthy", F.lit(False)))


def backfill(current: DataFrame, stale: DataFrame, limit: int) -> DataFrame:
    """Current rows, then stale ones with other URLs, up to a limit."""
    both = side_by_side(current, stale)
    once = both.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("side", "pos"))).where("__n = 1").drop("__n")
    return limited(renumbered(once, F.col("side"), F.col("pos")).drop("side"), limit)


def prioritize(df: DataFrame, first: Column) -> DataFrame:
    """Rows with ``first`` move to the front; both parts keep their order."""
    return renumbered(df, F.desc(F.coalesce(first, F.lit(False))), F.col("pos"))


def reserve(df: DataFrame, priority: str, score: str, limit: int) -> DataFrame:
    """The best priority row moves to the front, then the list is cut."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(priority), F.desc(score), "pos"))
    moved = df.withColumn("__first", F.col(priority) & (best == 1))
    return limited(renumbered(moved, F.desc("__first"), F.col("pos")).drop("__first"), limit)


def relevance_sorted(df: DataFrame) -> DataFrame:
    """By score, then number of engines, then position."""
    return renumbered(df, F.desc("score"), F.desc("n_engines"), F.col("pos"))
