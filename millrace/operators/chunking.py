"""Passages: overlapping windows of tokens, span checks, merging of spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fixed, text

WORD = re.compile(r"\S+")
#: Characters of windows that are sent on at once.
HELD = 1 << 20


def spans(doc: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of windows of words, in characters."""
    words = [m.span() for m in WORD.finditer(doc)]
    out = []
    for at in range(0, len(words), size - overlap):
        part = words[at : at + size]
        out.append((part[0][0], part[-1][1], len(part)))
        if at + size >= len(words):
            break
    return out


def packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["doc_id", "ordinal", "start", "end", "tokens", "text"])


def windows(batches: Iterator[pa.RecordBatch], size: int, overlap: int, tokenizer) -> Iterator[pa.RecordBatch]:
    """Batches of the windows of (doc_id, text), of about ``HELD`` characters each."""
    for batch in batches:
        rows, held = [], 0
        for doc_id, doc in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time
            doc = doc.as_py() or ""
            for i, (a, b, n) in enumerate(tokenizer(doc, size, overlap)):
                rows.append((doc_id.as_py(), i, a, b, n, doc[a:b]))
                held += b - a
                if held >= HELD:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)


def chunks(docs: DataFrame, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.OVERLAP_TOKENS, tokenizer=spans) -> DataFrame:
    """(doc_id, ordinal, start, end, tokens, text): windows of each document, in one pass without a shuffle.

    ``tokenizer(text, size, overlap)`` gives the spans; the built-in one counts words."""

    return docs.select("doc_id", "text").mapInArrow(lambda batches: windows(batches, size, overlap, tokenizer), "doc_id long, ordinal int, start int, end int, tokens int, text string")


def valid(found: DataFrame, doc: str = "document") -> DataFrame:
    """Chunks from spans (doc_id, pos, start, end, tokens, and the document): good spans, cleaned, renumbered.

    Spans must have tokens, lie in the document and begin after the one before."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag("start").over(w)
    good = found.withColumn("__before", before).where((F.col("tokens") > 0) & (F.col("start") >= 0) & (F.col("end") <= F.length(doc)) & (F.col("start") < F.col("end")) & (F.col("__before").isNull() | (F.col("start") > F.col("__before"))))
    cut = good.withColumn("text", cleaned(F.col(doc), F.col("start"), F.col("end"))).where(F.col("text") != "")
    return cut.withColumn("ordinal", F.row_number().over(w) - 1).drop("__before", "pos")


def cleaned(doc: Column, start: Column, end: Column) -> Column:
    """The span without white space and without words cut at its edges; as it is (trimmed) where nothing would be left."""
    raw = F.substr(doc, start + 1, end - start)
    char = lambda i: F.substr(doc, i, F.lit(1))
    solid = r"[\p{IsAlphabetic}\p{N}]"
    cut_left = (start > 0) & char(start).rlike(solid) & char(start + 1).rlike(solid)
    cut_right = char(end).rlike(solid) & char(end + 1).rlike(solid)
    x = F.when(cut_left, F.regexp_replace(raw, rf"^{solid}+", "")).otherwise(raw)
    y = text.strip(F.when(cut_right, F.regexp_replace(x, rf"{solid}+$", "")).otherwise(x))
    return F.when(y == "", text.strip(raw)).otherwise(y)


def merged(ranges: DataFrame, *key: str) -> DataFrame:
    """Ranges (key, start, end, priority) that overlap or touch become one; the smallest priority stays."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = ranges.withColumn("__new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("priority").alias("priority")).drop("__island")


def assembled(ranges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, passage, truncated): merged ranges by priority, with an ellipsis where text is left out."""
    joined = merged(ranges, "doc_id").join(docs.select("doc_id", F.col("text").alias("document")), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("start")
    gap = F.substr("document", F.lag("end").over(w) + 1, F.col("start") - F.lag("end").over(w))
    joined = joined.withColumn("__part", F.sum(F.coalesce((gap.rlike(r"\S")), F.lit(True)).cast("int")).over(w))
    blocks = joined.groupBy("doc_id", "__part").agg(F.first("document").alias("document"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("priority").alias("priority"))
    block = F.struct("priority", "start", "end", cleaned(F.col("document"), F.col("start"), F.col("end")).alias("text"))
    grouped = blocks.groupBy("doc_id").agg(F.first("document").alias("document"), F.sort_array(F.collect_list(block)).alias("b"), F.min("start").alias("first"), F.max("end").alias("last"))
    head, tail = F.substr("document", F.lit(1), F.col("first")).rlike(r"\S"), F.substr("document", F.col("last") + 1).rlike(r"\S")
    dots = lambda c: F.when(c, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>"))
    body = F.array(F.array_join(F.transform("b", lambda x: x["text"]), "\n\n…\n\n"))
    return grouped.select("doc_id", F.array_join(F.concat(dots(head), body, dots(tail)), "\n\n").alias("passage"), (head | tail | (F.size("b") > 1)).alias("truncated"))


def capped(scored: DataFrame, limit: int = fixed.CHUNKS_SCORED) -> DataFrame:
    """At most ``limit`` chunks of each document: half by lexical score (seeds with a wanted name and their
    neighbours first), the rest evenly spread, then from the start.  ``scored``: doc_id, ordinal, lexical, seed.

    Each rule names chunks in an order; a chunk has the place at which it is first named, and the first places are
    taken, so that windows over a document say all of it.  Only a document's seeds (half of ``limit``) are gathered."""
    quota = -(-limit // 2)
    doc = Window.partitionBy("doc_id")
    i, n = F.col("__i"), F.col("__n")
    d = scored.withColumn("__i", F.row_number().over(doc.orderBy("ordinal")) - 1).withColumn("__n", F.count(F.lit(1)).over(doc))
    ranked = F.coalesce(F.col("lexical") > 0, F.lit(False))
    seed = ranked & F.coalesce("seed", F.lit(False))
    d = d.withColumn("__seed", F.row_number().over(doc.orderBy(F.desc(seed), F.desc("lexical"), "__i")))
    seeds = F.collect_list(F.when(seed & (F.col("__seed") <= quota), F.struct(F.col("__seed").alias("rank"), i.alias("i")))).over(doc)
    # A seed names itself (distance 0) and its neighbours, the following one before the one in front.
    near = F.array_min(F.transform(seeds, lambda s: F.struct(F.abs(i - s["i"]).alias("distance"), s["rank"].alias("rank"), (i < s["i"]).alias("front"))))
    d = d.withColumn("__near", near)
    named = F.col("__near").isNotNull() | ranked
    first = F.row_number().over(doc.orderBy(F.desc(named), "__near", F.desc("lexical"), "__i"))
    d = d.withColumn("__lexical", named & (first <= quota))
    d = d.withColumn("__left", F.lit(limit) - F.sum(F.col("__lexical").cast("int")).over(doc))
    # Place k of the spread is the chunk k (n - 1) / (left - 1), rounded down; k is the smallest that reaches this chunk.
    spread = F.expr("CASE WHEN __left > 1 AND __n > 1 THEN ((__i * (__left - 1) + __n - 2) div (__n - 1)) * (__n - 1) div (__left - 1) = __i ELSE __left = 1 AND __i = __n - 1 END")
    place = F.row_number().over(doc.orderBy(F.when(F.col("__lexical"), 0).when(spread, 1).otherwise(2), "__i"))
    return d.withColumn("__place", place).where((n <= limit) | (F.col("__place") <= limit)).select(*scored.columns)
