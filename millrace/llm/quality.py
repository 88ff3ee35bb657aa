"""Quality by an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Every trusted document (label ``quality`` 1) is counted whole: tasks count their n-grams, the sums are
sharded by n-gram, and continuation counts, discounts, context totals and backed-off probabilities are
joins and aggregates between those shards.  The model lies in the shared folder as sorted shards of bounded size;
it is never collected or broadcast (only the list of its shards is).  A task joins the sorted n-grams of a batch of
texts with the shards in order: each level of backing off is a stretch of shards of its own, so that a batch reads
a shard once (twice where two levels meet in it), and a worker keeps a bounded number of them.  A document's perplexity is per byte over its whole
text.

Thresholds belong to languages.  A document's excess is the logarithm of its perplexity above the median of
the language's trusted documents, scaled down for short texts, whose perplexity varies more; the threshold
is a high quantile of the excess of the language's trusted documents, with some slack.  Text that repeats its
words is predictable, so no limit of perplexity finds it: the share of bytes whose n-gram is a repetition within
``WINDOW`` bytes has a threshold of the same kind.

Defined cases: null and empty texts have no perplexity and no threshold and are rejected; documents without a language form
a group of their own; a language with few trusted documents takes the median and quantile over all languages; without
any trusted text everything with text is kept; a document exactly at its threshold is kept; very long texts are scored
whole, a piece at a time; several labels of a document count as trusted if all say so;
repeated rows give repeated results; further columns are passed on.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

ORDER = 5
#: Bytes handled at once, n-grams a counting task holds before it passes them on.
PIECE, HELD = 1 << 19, 1 << 19
#: Entries of a shard of the model, and shards that a worker keeps.
SHARD, KEPT = 1 << 20, 4
#: Quantile of the excess of a language's trusted documents, the factor by which others may be above it, and the bytes at which the scale is the square root of a half.
HIGH, SLACK, SHORT = 0.998, 1.5, 200
#: Bytes within which an n-gram repeats another, and the share of repetitions that is allowed at least.
WINDOW, ALLOWED = 256, 0.25
#: One trusted document in so many sets limits instead of training their model; a language with fewer of those than ``FEW`` takes the limits over all.
FOLDS, FEW = 5, 20


def grams(texts: pa.Array, n: int = ORDER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, n-gram of every byte as a number, where each text's begin) in groups.

    A text is preceded by n - 1 zero bytes; the last byte of an n-gram is its lowest."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    every = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(whole):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        data, bounds = every[offsets[at] : offsets[to]].astype(np.uint64), offsets[at : to + 1] - offsets[at]
        key = data.copy()
        for k in range(1, n):
            shifted = data[:-k].copy() if k < len(data) else data[:0].copy()
            inside = bounds[(bounds > 0) & (bounds < len(data))]
            for j in range(k):  # the first k bytes of a text have nothing k bytes before them
                place = inside + j - k
                shifted[place[(place >= 0) & (place < len(shifted))]] = 0
            key[k:] |= shifted << np.uint64(8 * k)
        yield at, key, bounds
        at = to


def counts(texts: DataFrame) -> DataFrame:
    """(key, c): n-grams of column ``text``, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        keys, sums, pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merge():
            k = np.concatenate([keys, *(x for x, _ in pending)])
            c = np.concatenate([sums, *(x for _, x in pending)])
            u, inverse = np.unique(k, return_inverse=True)
            return u, np.bincount(inverse, c, len(u)).astype(np.int64)

        def out():
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].astype(np.int64)), pa.array(sums[i : i + 100_000])], ["key", "c"])

        for batch in batches:
            for _, key, _ in grams(batch.column(0)):
                pending.append(np.unique(key, return_counts=True))
                if sum(len(x) for x, _ in pending) > max(HELD // 4, len(keys)):
                    keys, sums = merge()
                    pending.clear()
                    if len(keys) > HELD:
                        yield from out()
                        keys, sums = keys[:0], sums[:0]
        keys, sums = merge()
        yield from out()

    return texts.select("text").mapInArrow(common.tidy(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> list[float]:
    """D1, D2, D3+ from how many n-grams have the counts 1 to 4."""
    n = {r[0]: r[1] for r in table.where("c <= 4").groupBy("c").count().collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


def entry(order: int, context: bool, key: Column) -> Column:
    """Name of a probability or a context's backing-off weight in the model."""
    return key.bitwiseOR(F.lit((2 * order + context) << 48))


def build(trusted: DataFrame) -> DataFrame:
    """The model: (entry, value) with natural logarithms of probabilities and weights."""
    levels = {ORDER: common.materialize(counts(trusted), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):  # how many different bytes come before
        levels[k] = common.materialize(levels[k + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c")), "kn-counts")
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(levels[k])
        table = levels[k].withColumn("context", F.shiftright("key", 8))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = table.withColumn("cut", cut)
        contexts = table.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("spare")).select("context", "total", (F.col("spare") / F.col("total")).alias("weight"))
        table = table.join(contexts, "context").withColumn("short", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        if lower is None:
            table = table.withColumn("below", F.lit(1 / 256))
        else:
            table = table.join(lower.withColumnRenamed("key", "short"), "short")
        p = ((F.col("c") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("below")).alias("below")
        lower = common.materialize(table.select("key", p), "kn-order")
        parts += [lower.select(entry(k, False, F.col("key")).alias("entry"), F.log("below").alias("value")), contexts.select(entry(k, True, F.col("context")).alias("entry"), F.log("weight").alias("value"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@dataclass
class Shards:
    """The shards of a model in ascending order of their entries: first entry, path and number of entries of each."""

    first: np.ndarray
    paths: list[str]
    sizes: list[int]


def save(model: DataFrame) -> Shards:
    """Write the model as sorted shards of about ``SHARD`` entries: the entries, then their values (float32)."""
    spark = model.sparkSession
    table = common.materialize(model, "kn-model")
    n = max(1, -(-table.count() // SHARD))
    folder = common.shared_dir(spark, "kn-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        keys, values = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy().astype("<u8"))
            values.append(batch.column(1).to_numpy().astype("<f4"))
        if sum(map(len, keys)):
            fs, top = common.filesystem(folder)
            fs.create_dir(top, recursive=True)
            name, key = f"{uuid.uuid4().hex}.shard", np.concatenate(keys)
            with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(key.tobytes())
                out.write(np.concatenate(values).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(key[0])], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(key)], pa.int64())], ["first", "path", "size"])

    parts = table.repartitionByRange(n, "entry").sortWithinPartitions("entry").mapInArrow(common.tidy(write), "first long, path string, size long")
    rows = sorted(common.materialize(parts, "kn-manifest").collect())  # one row for each shard that a finished task wrote
    return Shards(np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows], [r[2] for r in rows])


class Slots:
    """A hash table from numbers to values in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full((1 << self.bits) + 64, ~np.uint64(0), np.uint64), np.full((1 << self.bits) + 64, np.nan, np.float32)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.keys[at] == ~np.uint64(0)
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = first[free[first]]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], at[rest] + 1
            if len(at) and at.max() >= len(self.keys):
                raise ValueError("the hash table is too full")

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Fill ``out`` where a key is known."""
        at = self.place(keys)
        got = self.keys[at]
        hit = got == keys
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero(~hit & (got != ~np.uint64(0)))
        at = at[left] + 1
        while len(left):
            got = self.keys[at]
            hit = got == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (got != ~np.uint64(0))
            left, at = left[more], at[more] + 1


class Model:
    """Looks up sorted n-grams shard by shard; keeps the last ``KEPT`` shards, ``loads`` counts what was read."""

    def __init__(self, shards: Shards):
        self.shards, self.kept, self.loads = shards, OrderedDict(), 0

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.kept:
            while len(self.kept) >= KEPT:
                self.kept.popitem(last=False)
            fs, p = common.filesystem(self.shards.paths[i])
            with fs.open_input_stream(p, compression=None) as f:
                raw = f.read()
            n = self.shards.sizes[i]
            self.kept[i] = np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<f4", n, 8 * n)
            self.loads += 1
        self.kept.move_to_end(i)
        return self.kept[i]

    def look(self, order: int, context: bool, keys: np.ndarray) -> np.ndarray:
        """Values of n-grams in any order, NaN where there is none; the shards are read in ascending order."""
        u, inverse = np.unique(keys | np.uint64((2 * order + context) << 48), return_inverse=True)
        out = np.full(len(u), np.nan, np.float32)
        at = np.searchsorted(self.shards.first, u, "right") - 1
        for i in np.unique(at[at >= 0]).tolist():
            a, b = np.searchsorted(at, i), np.searchsorted(at, i, "right")
            entries, values = self.shard(i)
            place = np.minimum(np.searchsorted(entries, u[a:b]), len(entries) - 1)
            out[a:b] = np.where(entries[place] == u[a:b], values[place], np.nan)
        return out[inverse]

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each n-gram."""
        out = self.look(ORDER, False, keys)
        left = np.flatnonzero(np.isnan(out))
        total = np.zeros(len(left), np.float32)
        for k in range(ORDER, 0, -1):
            if not len(left):
                break
            weight = self.look(k, True, (keys[left] & np.uint64((1 << 8 * k) - 1)) >> np.uint64(8))
            total += np.where(np.isnan(weight), 0, weight)
            p = self.look(k - 1, False, keys[left] & np.uint64((1 << 8 * (k - 1)) - 1)) if k > 1 else np.full(len(left), np.log(1 / 256), np.float32)
            known = ~np.isnan(p)
            out[left[known]] = total[known] + p[known]
            left, total = left[~known], total[~known]
        return out

    def table(self, texts: pa.Array) -> Slots:
        """Log probabilities of all the n-grams of some texts."""
        found = np.zeros(0, np.uint64)
        pending: list[np.ndarray] = []
        for _, keys, _ in grams(texts):
            keys.sort()
            pending.append(keys[np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))] if len(keys) else keys)
        if pending:
            found = np.concatenate(pending)
            found.sort()
            found = found[np.flatnonzero(np.append(True, found[1:] != found[:-1]))] if len(found) else found
        return Slots(found, self.logs(found))


def model_of(shards: Shards) -> Model:
    return common.held(("kn", *shards.paths), lambda: Model(shards))


def repeated(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of each text's bytes whose n-gram is not the first of its kind in a window."""
    n = np.diff(bounds)
    windows = -(-n // WINDOW)
    before = np.cumsum(windows) - windows
    at = (np.arange(len(keys)) - np.repeat(bounds[:-1], n)) // WINDOW + np.repeat(before, n)
    every = at.astype(np.uint64) << np.uint64(8 * ORDER) | keys
    every.sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    kinds = np.concatenate(([0], np.cumsum(np.bincount((every[new] >> np.uint64(8 * ORDER)).astype(np.int64), minlength=int(windows.sum())))))
    return 1 - (kinds[before + windows] - kinds[before]) / np.maximum(1, n)


def score(docs: DataFrame, shards: Shards) -> DataFrame:
    """``docs`` with ``n_bytes``, ``perplexity`` and ``repeated`` of column ``text``; other columns are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shards)
        for batch in batches:
            texts = batch.column("text")
            known = model.table(texts)
            out, again, size = np.ones(len(batch)), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for at, keys, bounds in grams(texts):
                logs = np.empty(len(keys), np.float32)
                known.look(keys, logs)
                total = np.concatenate(([0.0], np.cumsum(logs, dtype=np.float64)))[bounds]
                n = np.diff(bounds)
                out[at : at + len(n)] = np.exp(-np.diff(total) / np.maximum(1, n))
                again[at : at + len(n)] = repeated(keys, bounds)
                size[at : at + len(n)] = n
            yield pa.RecordBatch.from_arrays([*(c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "text"), pa.array(size), pa.array(out, mask=size == 0), pa.array(again)], [*(f.name for f in batch.schema if f.name != "text"), "n_bytes", "perplexity", "repeated"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(common.tidy(run), f"{schema}, n_bytes long, perplexity double, repeated double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


class Limits:
    """Medians and quantiles of trusted documents by language, as small tables."""

    def __init__(self, known: DataFrame):
        """``known``: lang, n_bytes, perplexity and repeated of the trusted documents."""
        of = F.col("lang").alias("of")
        middle = lambda q, name: F.percentile_approx(F.log("perplexity"), q, 10_000).alias(name)
        self.medians, self.median = common.small(known.groupBy("lang").agg(middle(0.5, "median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW).select(of, "median")), known.agg(middle(0.5, "median0"))
        excess = self.centred(known)
        top = lambda name: (SLACK * F.percentile_approx("excess", HIGH, 10_000)).alias(name)
        most = lambda name: F.when(F.count("repeated") > 0, F.greatest(F.lit(ALLOWED), SLACK * F.percentile_approx("repeated", HIGH, 10_000))).alias(name)
        self.tops, self.top = common.small(excess.groupBy("lang").agg(top("top"), most("most"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW).select(of, "top", "most")), excess.agg(top("top0"), most("most0"))

    def centred(self, rows: DataFrame) -> DataFrame:
        """Adds median, scale and excess (see the module)."""
        rows = rows.join(self.medians, rows["lang"].eqNullSafe(F.col("of")), "left").drop("of").join(F.broadcast(self.median))
        rows = rows.withColumn("median", F.coalesce("median", "median0")).withColumn("scale", F.sqrt(F.col("n_bytes") / (F.col("n_bytes") + SHORT)))
        return rows.withColumn("excess", (F.log("perplexity") - F.col("median")) * F.col("scale"))

    def decided(self, rows: DataFrame) -> DataFrame:
        """Adds threshold (of perplexity) and keep."""
        out = self.centred(rows)
        out = out.join(self.tops, out["lang"].eqNullSafe(F.col("of")), "left").join(F.broadcast(self.top)).withColumn("top", F.coalesce("top", "top0")).withColumn("most", F.coalesce("most", "most0"))
        keep = F.col("perplexity").isNotNull() & F.coalesce((F.col("excess") <= F.col("top")) & (F.col("repeated") <= F.col("most")), F.lit(True))
        return out.withColumn("threshold", F.exp(F.col("median") + F.try_divide("top", "scale"))).withColumn("keep", keep)


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Limits, Shards]:
    """(limits, shards of the model).

    The model counts all trusted documents.  A document that a model was trained on is easier for it than
    others, so limits come from a second model, without one trusted document in ``FOLDS``, scored on those."""
    trusted = docs.select("doc_id", "lang", "text").join(common.small(trusted_ids(labels)), "doc_id", "left_semi")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    known = score(trusted.where(apart).select("lang", "text"), save(build(trusted.where(~apart))))
    limits = Limits(common.materialize(known.where("perplexity is not null"), "kn-known"))
    return limits, save(build(trusted))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep) for every document."""
    limits, shards = trained(docs, labels)
    scored = score(docs.select("doc_id", "lang", "text"), shards)
    return limits.decided(scored).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "keep")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; no document is shuffled."""
    limits, shards = trained(docs, labels)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("lang").alias("lang"), F.col("text").alias("text"))
    return limits.decided(score(packed, shards)).where("keep").select("row.*")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Perplexity, thresholds and decision for every document."""
    common.prepare(spark)
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
