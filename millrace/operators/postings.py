"""An inverted index for lexical evidence, and top lists that leave most of it unread.

A block has the sorted ids of the documents of one term in one range of ``SPAN`` ids, so a term that is in most
documents is many blocks and no group is larger than a range.  Blocks are stored ordered by term and range (files and row
groups are skipped by their statistics); term frequencies are a table beside them.

A document's score is a sum of shares of its terms (``evidence.coverage``), so the terms of a query are taken up by
falling share.  After each the open ones bound what a document without any of the taken ones could still get; once the
k-th best score is above that bound, such documents need not be looked for.  Of the other terms only
blocks of ranges with a candidate are read, to complete the candidates' scores.  A block's largest share is that of its term,
as a document has a term or not: what differs between blocks is their range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.operators import evidence
from millrace.operators.stored import folder, small, stored

#: Ids of a block's range; most ranges that are named in a filter.
SPAN, NAMED = 4096, 2000
#: What rounding may put between equal scores.
EDGE = 1e-9


@dataclass
class Postings:
    """``path``/blocks: term, cell, n, docs; ``path``/terms: term, df; and how many documents there are."""

    path: str
    documents: int

    def blocks(self, spark) -> DataFrame:
        return spark.read.schema("term string, cell long, n int, docs array<long>").parquet(f"{self.path}/blocks")

    def terms(self, spark) -> DataFrame:
        return spark.read.schema("term string, df long").parquet(f"{self.path}/terms")


def build(docs: DataFrame, path: str | None = None) -> Postings:
    """Index all documents (doc_id, text); a document is counted once for each of its terms."""
    spark = docs.sparkSession
    path = path or folder(spark, "postings")
    found = docs.where("doc_id is not null").select("doc_id", F.explode(text.term_set(F.col("text"))).alias("term"))
    cell = F.floor(F.col("doc_id") / SPAN).cast("long")
    blocks = found.groupBy("term", cell.alias("cell")).agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    blocks = blocks.select("term", "cell", F.size("docs").alias("n"), "docs")
    blocks.repartitionByRange("term", "cell").sortWithinPartitions("term", "cell").write.parquet(f"{path}/blocks")
    index = Postings(path, docs.count())
    index.blocks(spark).groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    return index


def shares(index: Postings, queries: DataFrame) -> DataFrame:
    """(query_id, term, share, rank, rest): what a term adds to a score, terms by falling share, and the sum of all later ones."""
    terms = evidence.query_terms(queries)
    df = index.terms(queries.sparkSession).join(wanted(terms), "term")
    weighted = evidence.weighted(terms, df, index.documents)
    w = Window.partitionBy("query_id")
    total, decisive = F.sum("weight").over(w), F.sum(F.when(F.col("decisive"), F.col("weight"))).over(w)
    d = fixed.DECISIVE_SHARE
    share = F.when(decisive.isNull(), F.col("weight") / total).otherwise((1 - d) * F.col("weight") / total + F.when(F.col("decisive"), d * F.col("weight") / decisive).otherwise(0.0))
    order = w.orderBy(F.desc("share"), "df", "pos")
    found = weighted.withColumn("share", share).where("df > 0").withColumn("rank", F.row_number().over(order))
    rest = F.sum("share").over(order.rowsBetween(1, Window.unboundedFollowing))
    return found.select("query_id", "term", "df", "share", "rank", F.coalesce(rest, F.lit(0.0)).alias("rest"))


def wanted(terms: DataFrame) -> DataFrame:
    """Distinct terms, broadcast if they are few."""
    t = terms.select("term").distinct()
    return F.broadcast(t) if small(t) else t


def listed(blocks: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``blocks`` with a filter on ``column`` that reaches the files, if the values are few."""
    few = [r[0] for r in values.select(column).distinct().limit(NAMED + 1).collect()]
    return blocks.where(F.col(column).isin(few)) if len(few) <= NAMED else blocks


def top(index: Postings, queries: DataFrame, k: int, read: list | None = None) -> DataFrame:
    """(query_id, doc_id, score, place): the ``k`` best documents of each query, ties by id; the same rows as scoring all.

    ``read`` gets how many postings each step has decoded."""
    spark = queries.sparkSession
    plan = stored(shares(index, queries), "query-shares")
    blocks = listed(index.blocks(spark), "term", plan)
    many = F.broadcast if small(plan) else (lambda df: df)
    # The first terms that have k documents together, and then one more term of each open query a round.
    far = F.sum("df").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    level = stored(plan.withColumn("before", F.coalesce(far, F.lit(0))).where(F.col("before") < k).groupBy("query_id").agg(F.max("rank").alias("level")), "query-levels")
    while True:
        now = plan.join(many(level), "query_id")
        taken = now.where("rank <= level")
        hits = blocks.join(many(taken), "term").select("query_id", "cell", F.explode("docs").alias("doc_id"), "share")
        pool = stored(hits.groupBy("query_id", "cell", "doc_id").agg(F.sum("share").alias("score")), "query-pool")
        others = now.where("rank > level").select("query_id", "term", "share")
        asked = pool.select("query_id", "cell").distinct()
        cells = listed(blocks, "cell", asked).join(many(others), "term").join(asked, ["query_id", "cell"])
        cells = stored(cells.select("query_id", "cell", "share", "n", "docs"), "query-cells")
        more = pool.select("query_id", "cell", "doc_id").join(cells, ["query_id", "cell"]).where(F.array_contains("docs", F.col("doc_id")))
        parts = pool.select("query_id", "doc_id", "score").unionByName(more.select("query_id", "doc_id", F.col("share").alias("score")))
        scored = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 9).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        best = stored(scored.withColumn("place", place).where(F.col("place") <= k), "query-best")
        if read is not None:
            read.append((taken.agg(F.sum("df")).first()[0] or 0) + (cells.agg(F.sum("n")).first()[0] or 0))
        last = best.where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        state = now.groupBy("query_id", "level").agg(F.max("rank").alias("ranks"), F.max(F.when(F.col("rank") == F.col("level"), F.col("rest"))).alias("rest"))
        state = state.join(last, "query_id", "left")
        open_ = (F.col("level") < F.col("ranks")) & (F.coalesce(F.col("least"), F.lit(0.0)) - EDGE <= F.col("rest"))
        if state.where(open_).isEmpty():
            return best
        level = stored(state.select("query_id", F.when(open_, F.col("level") + 1).otherwise(F.col("level")).alias("level")), "query-levels")
