"""Lexical evidence: rarity weights of query terms and weighted coverage of texts.

The scope of document frequencies is all rows of ``docs``.  A document's distinct terms are cut to the
(few) query terms before they become rows; beyond ``INLINE_TERMS`` they meet in an equi-join.  Nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed, text

#: Largest number of query terms that is broadcast; beyond it the join shuffles.
BROADCAST_TERMS = 200_000
#: Largest number of query terms that is held in the plan itself.
INLINE_TERMS = 2_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, pos, term, acronym)."""
    acronyms = F.transform(F.regexp_extract_all("query", F.lit(r"\b[A-Z]{3,8}\b"), 0), text.ascii_lower)
    exploded = queries.select("query_id", acronyms.alias("acronyms"), F.posexplode(text.lexical_terms(F.col("query"))).alias("pos", "term"))
    return exploded.select("query_id", "pos", "term", F.array_contains("acronyms", F.col("term")).alias("acronym"))


def small(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term) for documents with a query term."""
    wanted = terms.select("term").distinct()
    listed = sorted(r[0] for r in wanted.limit(INLINE_TERMS + 1).collect())
    if len(listed) <= INLINE_TERMS:
        return docs.select("doc_id", F.explode(F.array_intersect(text.term_set(F.col("text")), text.words_of(listed))).alias("term"))
    wanted = small(wanted)
    return docs.select("doc_id", F.explode(text.term_set(F.col("text"))).alias("term")).join(wanted, "term").select("doc_id", "term")


def weights(terms: DataFrame, hits: DataFrame, n: Column | int) -> DataFrame:
    """(query_id, pos, term, df, weight, decisive): ln((n + 1) / (df + 1)) + 1; the two rarest telling terms decide."""
    return weighted(terms, hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n)


def weighted(terms: DataFrame, df: DataFrame, n: Column | int) -> DataFrame:
    """``weights`` from document frequencies (term, df)."""
    n = n if isinstance(n, Column) else F.lit(n)
    t = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    t = t.withColumn("weight", F.log((n + 1) / (F.col("df") + 1)) + 1)
    telling = (F.col("df") > 0) & ~text.is_digits(F.col("term")) & ~text.is_month(F.col("term")) & ~text.is_year(F.col("term")) & ~F.col("acronym")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("telling"), F.desc("weight"), "pos"))
    return t.withColumn("telling", telling).withColumn("decisive", F.col("telling") & (rank <= 2)).select("query_id", "pos", "term", "df", "weight", "decisive")


def coverage(found_weights: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): share of the weight that a document matches; decisive terms count for 40 %."""
    totals = found_weights.groupBy("query_id").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("decisive"), F.col("weight"))).alias("total_decisive"))
    found = hits.join(small(found_weights), "term").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("got"), F.sum(F.when(F.col("decisive"), F.col("weight")).otherwise(0.0)).alias("got_decisive"))
    share = F.col("got") / F.col("total")
    d = fixed.DECISIVE_SHARE
    blend = F.when(F.col("total_decisive").isNull(), share).otherwise((1 - d) * share + d * F.col("got_decisive") / F.col("total_decisive"))
    return found.join(small(totals), "query_id").select("query_id", "doc_id", blend.alias("score"))


def with_identifiers(lexical: Column, wanted: Column, found: Column) -> Column:
    """Blend of lexical coverage with the share of wanted compound names that a text has."""
    share = found / F.greatest(wanted, F.lit(1))
    return F.when(wanted > 0, (1 - fixed.IDENTIFIER_SHARE) * lexical + fixed.IDENTIFIER_SHARE * share).otherwise(lexical)


def recommends(passage: Column, decisive: Column, acronyms: Column, year: Column) -> Column:
    """1.0 if a sentence has an action word and the decisive term, and the passage names the issuer and the year."""
    ts = text.term_set(passage)
    expansions = F.create_map(*[v for k, e in fixed.ISSUERS.items() for v in (F.lit(k), text.words_of(e))])
    named = F.forall(acronyms, lambda a: F.array_contains(ts, a) | F.coalesce(F.size(F.array_except(F.try_element_at(expansions, a), ts)) == 0, F.lit(False)))
    dated = year.isNull() | F.array_contains(text.years(passage), year)
    sentence = F.exists(F.split(passage, r"[.!?\n;]"), lambda s: text.let(text.tokens(s), lambda t: text.has_any(t, fixed.ACTIONS) & F.array_contains(t, decisive)))
    return F.coalesce((named & dated & sentence).cast("double"), F.lit(0.0))


def adds_terms(excerpt: Column, content: Column, terms: Column) -> Column:
    """Does an excerpt have a query term that the content lacks?"""
    return F.size(F.array_except(F.array_intersect(text.term_set(excerpt), terms), text.term_set(content))) > 0


def numeric_consensus(facts: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) from (query_id, doc_id, site, fact): facts of three sites or more, best fact of each document."""
    support = facts.groupBy("query_id", "fact").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= fixed.NUMERIC_DOMAINS)
    most = F.max("sites").over(Window.partitionBy("query_id"))
    scored = support.withColumn("score", fixed.NUMERIC_WEIGHT * F.col("sites") / most)
    return facts.join(scored, ["query_id", "fact"]).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
