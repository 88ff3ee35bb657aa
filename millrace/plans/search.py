"""Retrieval end to end over tables: evidence, shortlist, passages, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.operators import budget, chunking, evidence, rank


def validated(queries: DataFrame, num_results: int = fixed.DEFAULT_RESULTS, context_max_chars: int = fixed.DEFAULT_BUDGET) -> DataFrame:
    """Queries that are not blank; raises for limits out of range."""
    if not 1 <= num_results <= fixed.MOST_RESULTS:
        raise ValueError(f"num_results must be between 1 and {fixed.MOST_RESULTS}")
    if not 1 <= context_max_chars <= fixed.MOST_BUDGET:
        raise ValueError(f"context_max_chars must be between 1 and {fixed.MOST_BUDGET}")
    return queries.where(text.strip(F.col("query")) != "")


def search(queries: DataFrame, docs: DataFrame, num_results: int = fixed.DEFAULT_RESULTS, context_max_chars: int = fixed.DEFAULT_BUDGET) -> DataFrame:
    """Best documents of each query with their best passages, within a budget of characters.

    ``queries``: query_id, query.  ``docs``: doc_id, text and optionally url, title, date, source_priority,
    upstream_consensus, dense (a score per document).  Result: query_id, pos, doc_id, title, url, date, content,
    full_length, from_snippet, truncated.  Documents are read twice (evidence, then the chosen ones' passages);
    candidates shrink to 32 per query before any text moves."""
    wanted = {"url": "string", "title": "string", "date": "string", "source_priority": "boolean", "upstream_consensus": "boolean", "dense": "double"}
    for name, kind in wanted.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    queries = validated(queries, num_results, context_max_chars)
    terms = evidence.query_terms(queries)
    hits = evidence.matches(docs, terms)
    weighted = evidence.weights(terms, hits, docs.count())
    scores = evidence.coverage(weighted, hits)
    flags = docs.select("doc_id", F.coalesce("source_priority", F.lit(False)).alias("source_priority"), F.coalesce("upstream_consensus", F.lit(False)).alias("upstream_consensus"), F.coalesce("dense", F.lit(0.0)).alias("dense"))
    q = Window.partitionBy("query_id")
    place = F.row_number().over(q.orderBy(F.desc("score"), "doc_id"))  # a limit on the rank itself is applied before the shuffle too
    pool = scores.withColumn("place", place).where(F.col("place") <= fixed.POOL).withColumn("pos", F.col("place") - 1).drop("place")
    pool = pool.join(flags, "doc_id").withColumn("score", F.col("dense") + F.col("score"))
    short = evidence.small(rank.shortlist(pool, num_results).select("query_id", "doc_id", "selected", "pos"))  # num_results rows per query
    chosen = docs.join(short, "doc_id")
    parts = chunking.chunks(chosen.select("doc_id", "text").dropDuplicates(["doc_id"]))
    chunk_hits = parts.select("doc_id", "ordinal", F.explode(text.term_set(F.col("text"))).alias("term")).join(evidence.small(weighted), "term")
    chunk_scores = chunk_hits.join(short, ["query_id", "doc_id"]).groupBy("query_id", "doc_id", "ordinal").agg(F.sum("weight").alias("score"))
    best = rank.best_chunks(chunk_scores).join(parts.select("doc_id", "ordinal", "start", "end"), ["doc_id", "ordinal"])
    keyed = best.select(F.struct("query_id", "doc_id").alias("doc_id"), "start", "end", F.col("selected").alias("priority"))
    bodies = chosen.select(F.struct("query_id", "doc_id").alias("doc_id"), "text")
    passages = chunking.assembled(keyed, bodies).select("doc_id.query_id", "doc_id.doc_id", "passage", "truncated")
    rows = passages.join(chosen.select("query_id", "doc_id", "pos", "title", "url", "date", F.length("text").alias("full_length")), ["query_id", "doc_id"])
    rows = rows.withColumnRenamed("passage", "content").withColumn("from_snippet", F.lit(False))
    out = budget.allocate(rows, "query_id", "content", "pos", context_max_chars)
    return out.select("query_id", "pos", "doc_id", "title", "url", F.substring("date", 1, 10).alias("date"), "content", "full_length", "from_snippet", "truncated")


def as_json(results: DataFrame) -> DataFrame:
    """(query_id, response): one JSON document per query, fields as the HTTP interface names them, nulls left out."""
    row = F.struct("pos", F.col("title"), F.col("url"), F.col("date"), F.col("content"), F.col("full_length").alias("fullLength"), F.col("from_snippet").alias("fromSnippet"), "truncated")
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda r: r.dropFields("pos"))
    return results.groupBy("query_id").agg(F.to_json(F.struct(listed.alias("results"))).alias("response"))


def demo(spark, sf_dir: str) -> DataFrame:
    from millrace.plans.relational import lookups

    return search(lookups(spark), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
