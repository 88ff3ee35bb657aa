"""Benchmark decontamination by spaced seeds.

A seed is a mask over word positions; it hashes the words at its ones and ignores those at its zeros, so
a substituted word does not hide a passage from all masks.  Seeds of the benchmark's items (the query set)
are looked up at every position of every document; hits on one diagonal are verified by the best
ungapped segment, counting matches against substitutions.  A document is contaminated by an item if the
segment matches ``SHARE`` of the item's words, or ``RUN`` words, at an identity of at least ``IDENTITY``.
The masks miss none of these: however the substitutions lie in such a segment, a mask fits its matches
(the tests go through all of them).

The benchmark goes to the workers in blocks of at most ``BLOCK_WORDS`` words (one scan of the documents for
each block), whatever its size; documents are never shuffled.

Defined cases: null and empty texts contain nothing; an item of fewer than ``LEAST`` words is found only whole, word for
word (its mask has no gaps); items without words match nothing; of several segments of a text and item the one with
most matches counts, then the longest; very long texts are read whole; repeated rows and items give repeated
results; an empty benchmark finds nothing; null ids are passed on; further columns are ignored by ``overlaps`` and
kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common, tokens

#: Masks of weight 4 for all items, then those of weight 3 that items of fewer than ``SHORT`` words need besides, then
#: those that are only for items of so many words.  (Without "1111" a segment could hide from the masks of weight 4:
#: the tests go through all placements of substitutions.)
MASKS = ("1111", "11011", "10111", "11101", "111", "1011", "1101", "11", "1")
LEAST, SHORT, SHARE, RUN, IDENTITY = 5, 11, 0.6, 13, 0.7
BLOCK_WORDS = 2_000_000
#: Words compared at once on the diagonals of hits.
COMPARED = 1 << 20
BITS = 22


def places(mask: str) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask) if c == "1"])


def seeds(hashes: np.ndarray, m: int) -> np.ndarray:
    """Seed of mask m at each position where it fits."""
    n = len(hashes) - len(MASKS[m]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, m + 1, np.uint64)
    for i in places(MASKS[m]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return tokens.mixed(h)


class Index:
    """Seeds of a block of items."""

    def __init__(self, ids: list, texts: pa.Array):
        items, found, used = [], [], set()
        for at, w in tokens.pieces(texts):
            for i in range(len(w.first) - 1):
                words = w.hashes[w.first[i] : w.first[i + 1]]
                if not len(words):
                    continue
                items.append((ids[at + i], words))
                for m, mask in enumerate(MASKS):
                    weight = mask.count("1")
                    if weight == 4 or weight == 3 and len(words) < SHORT if len(words) >= LEAST else mask == "1" * len(words):
                        used.add(m)
                        h = seeds(words, m)
                        found.append(np.stack([h, np.full(len(h), len(items) - 1, np.uint64), np.arange(len(h), dtype=np.uint64)]))
        self.ids = [i for i, _ in items]
        self.first = np.cumsum([0, *(len(x) for _, x in items)])
        self.words = np.concatenate([x for _, x in items]) if items else np.zeros(0, np.uint64)
        every = np.concatenate(found, 1) if found else np.zeros((3, 0), np.uint64)
        every = every[:, np.argsort(every[0], kind="stable")]
        self.seeds, self.item, self.at = every[0], every[1].astype(np.int64), every[2].astype(np.int64)
        self.masks = sorted(used)
        n = np.diff(self.first)
        #: Matching words that an item needs.
        self.least = np.where(n < LEAST, n, np.minimum(RUN, SHARE * n))
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[(self.seeds & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True

    def diagonals(self, w: tokens.Words) -> np.ndarray:
        """Distinct (text, item, position of the item's first word) with a seed in common and enough matching words, [n, 3].

        Seeds that many items share are compared ``COMPARED`` pairs at a time; only what matches is held."""
        out = [np.zeros((0, 3), np.int64)]
        for m in self.masks:
            h = seeds(w.hashes, m)
            p = np.flatnonzero(self.filter[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)])
            low, high = np.searchsorted(self.seeds, h[p]), np.searchsorted(self.seeds, h[p], "right")
            p, low, n = p[high > low], low[high > low], (high - low)[high > low]
            text = np.searchsorted(w.first, p, "right") - 1
            inside = p + len(MASKS[m]) <= w.first[text + 1]
            p, low, n, text = p[inside], low[inside], n[inside], text[inside]
            ends, a = np.cumsum(n), 0
            while a < len(p):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + COMPARED, "right")))
                k = np.repeat(low[a:b], n[a:b]) + np.arange(n[a:b].sum()) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
                rows = np.stack([np.repeat(text[a:b], n[a:b]), self.item[k], np.repeat(p[a:b], n[a:b]) - self.at[k]], 1)
                out.append(self.likely(w, np.unique(rows, axis=0)))
                a = b
        return np.unique(np.concatenate(out), axis=0)

    def likely(self, w: tokens.Words, rows: np.ndarray) -> np.ndarray:
        """The diagonals with enough matching words for a segment, wherever these are."""
        text, item, start = rows.T
        low = np.maximum(start, w.first[text])
        n = np.minimum(start + self.first[item + 1] - self.first[item], w.first[text + 1]) - low
        least = self.least[item]
        keep, ends, a = np.zeros(len(rows), bool), np.cumsum(n), 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + COMPARED, "right")))
            first = np.cumsum(n[a:b]) - n[a:b]
            at = np.arange(n[a:b].sum()) - np.repeat(first - low[a:b], n[a:b])
            same = w.hashes[at] == self.words[at + np.repeat(self.first[item[a:b]] - start[a:b], n[a:b])]
            keep[a:b] = np.add.reduceat(same, first, dtype=np.int64) >= least[a:b]
            a = b
        return rows[keep]

    def verified(self, w: tokens.Words) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (matching words, words of the segment) for contaminated texts."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, start in self.diagonals(w).tolist():
            words = self.words[self.first[item] : self.first[item + 1]]
            a, b = max(start, int(w.first[text])), min(start + len(words), int(w.first[text + 1]))
            same = w.hashes[a:b] == words[a - start : b - start]
            matches, length = segment(same)
            if matches >= self.least[item] and matches >= IDENTITY * length and matches > out.get((text, item), (0, 0))[0]:
                out[text, item] = (matches, length)
        return out


def segment(same: np.ndarray) -> tuple[int, int]:
    """(matches, length) of the stretch with the largest matches minus mismatches."""
    if not len(same):
        return 0, 0
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -1))))
    low = np.minimum.accumulate(total)
    to = int(np.argmax(total - low))
    frm = int(np.argmin(total[: to + 1]))
    return int(same[frm:to].sum()), to - frm


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark as indexes of about ``BLOCK_WORDS`` words each."""
    items = benchmark.where("text is not null").select("item_id", "text")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-words // (6 * BLOCK_WORDS)))
    for k in range(n):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        if len(table):
            yield Index(table["item_id"].to_pylist(), table["text"].combine_chunks())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matches, length, item_words) for each contaminated document and item."""
    out = None
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            common.release()
            index = shared.value
            for batch in batches:
                rows = []
                for at, w in tokens.pieces(batch.column(1)):
                    for (text, item), (matches, length) in index.verified(w).items():
                        rows.append((batch.column(0)[at + text].as_py(), index.ids[item], matches, length, int(index.first[item + 1] - index.first[item])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "matches", "length", "item_words"])

        part = docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, item_id long, matches long, length long, item_words long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matches long, length long, item_words long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            common.release()
            index = shared.value
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for at, w in tokens.pieces(batch.column("text")):
                    keep[[at + text for text, _ in index.verified(w)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(common.tidy(run), docs.schema)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item found in it."""
    common.prepare(spark)
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
