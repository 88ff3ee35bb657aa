"""Queries of indexes, learned vectors, token windows and ordered matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import learned, subwords, text, urls
from millrace.operators import chunking, matching, postings, vectorindex
from millrace.operators.stored import stored
from millrace.plans import sql
from millrace.plans.registry import query, table
from millrace.plans.relational import SCORE, lookups

#: Vocabulary of the token windows.
VOCABULARY = "byte_bpe_50k.json"


@query("v1_index_search")
def v1_index_search(spark, sf_dir):
    """V1: ten nearest vectors of every row whose id is divisible by 50, through inverted lists; recall is audited."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0")
    index = vectorindex.tuned(vectorindex.build(rows), queries, rows, 10)
    return vectorindex.search(index, queries, rows, 10)


@query("o2_index_top", f"WITH {SCORE} SELECT query_id, doc_id, round(s, 9) AS score, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM score) WHERE r <= 32")
def o2_index_top(spark, sf_dir):
    """A1, A2, O2: the candidate pool from an inverted index, the same rows as ``o2_lexical_top``."""
    return postings.top(postings.build(table(spark, sf_dir, "documents")), lookups(spark), 32)


@query("o2_index_terms", f"SELECT t AS term, count(*) AS df FROM (SELECT unnest(list_distinct({sql.tokens('text')})) AS t FROM documents) GROUP BY t")
def o2_index_terms(spark, sf_dir):
    """A1: document frequencies of all terms, from the index's blocks."""
    return postings.build(table(spark, sf_dir, "documents")).terms(spark)


def page_results(spark, sf_dir):
    """Pages as results of one query for each language, in the order of their ids."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    key = urls.canonical(urls.parse(F.col("url")))
    return table(spark, sf_dir, "pages").select(lang.alias("query_id"), F.col("page_id").alias("pos"), "url", title.alias("title"), F.lit(None).cast("string").alias("date"), F.substring("html", 1, 0).alias("snippet"), F.lit(None).cast("string").alias("doi"), F.array(key).alias("url_keys"), text.title_key(title).alias("title_key"), (F.col("page_id") % 10 == 0).alias("source_priority"))


@query("j2_entities")
def j2_entities(spark, sf_dir):
    """All pages of a language matched in order, by URL key or equivalent title."""
    return matching.things(page_results(spark, sf_dir))


@query("x1_token_windows")
def x1_token_windows(spark, sf_dir):
    """Windows of 512 subword tokens with 64 in common."""
    import public_tokenizers

    c = chunking.chunks(table(spark, sf_dir, "documents"), tokenizer=subwords.windows(public_tokenizers.path(VOCABULARY)))
    return c.select("doc_id", "ordinal", "start", "end", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("v3_learned_vectors")
def v3_learned_vectors(spark, sf_dir):
    """V2, V3: vectors of all documents in the leading singular directions of their terms.

    Directions of equal strength may turn between runs, so the row has what does not depend on that: how many
    numbers a vector has, its length, and which share of the text's weight it holds."""
    docs = table(spark, sf_dir, "documents")
    rows = stored(learned.counted(learned.features(docs, "doc_id", "text")), "features")
    found = learned.embedded(rows, "doc_id", learned.fitted(rows))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return found.select("doc_id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"), F.round("share", 3).alias("share"))
