"""Vectors of texts learned from the corpus: the leading singular vectors of its weighted term-document matrix.

A text is a sparse row over ``FEATURES`` hashed terms: log(1 + count) times rarity, of length 1.  Randomised subspace iteration
multiplies a matrix of ``FEATURES`` rows and a few columns by the corpus's Gram matrix: tasks go through their rows with
that matrix broadcast (its size does not depend on the corpus) and return their sums by block of features, the
blocks' sums meet in one task each, and the driver only makes the columns orthogonal again.  No weights from outside
are used, and nothing as large as the corpus is ever in one place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.stored import stored

FEATURES, DIMS, EXTRA, ROUNDS, SEED = 1 << 14, 32, 16, 4, 0
#: Features of a block of sums; terms that are counted at once.
BLOCK, TERMS = 256, 1 << 18


@dataclass
class Model:
    """Rarity of features, right singular vectors (features by dims), singular values."""

    rarity: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def features(texts: DataFrame, key: str, column: str, n: int = FEATURES) -> DataFrame:
    """(key, terms): the hashed terms of every text, with repeats."""
    terms = F.transform(text.tokens(F.coalesce(F.col(column), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(n)).cast("int"))
    return texts.select(F.col(key).alias("key"), terms.alias("terms"))


def slices(terms: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(place, slice) of a column of texts, of about ``TERMS`` terms each, or one text."""
    ends = np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(terms):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + TERMS, "right")))
        yield a, terms.slice(a, b - a)
        a = b


def counted(rows: DataFrame) -> DataFrame:
    """(key, features, counts): the different terms of every text of ``features``, and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, terms in slices(batch.column(1)):
                lengths = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                cell, count = np.unique(np.repeat(np.arange(len(terms)), lengths) << 32 | terms.flatten().to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(cell, np.arange(len(terms) + 1) << 32).astype(np.int32))
                found = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cell & 0xFFFFFFFF, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(terms)), *found], ["key", "features", "counts"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, features array<int>, counts array<int>")


def sparse(lists: pa.Array, counts: pa.Array, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text ends, after a 0; feature; weight) of texts; each has length 1 and every feature once."""
    ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
    feature = lists.flatten().to_numpy()
    w = np.log1p(counts.flatten().to_numpy()) * rarity[feature]
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    norm = np.sqrt(np.bincount(row, w * w, len(lists)))
    return ends, feature, w / np.where(norm > 0, norm, 1)[row]


def products(ends: np.ndarray, place: np.ndarray, w: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sparse rows times a matrix of a few columns; one row at a time, so that what it gathers stays in the cache."""
    out = np.zeros((len(ends) - 1, right.shape[1]))
    for i in np.flatnonzero(np.diff(ends)).tolist():
        a, b = ends[i], ends[i + 1]
        out[i] = w[a:b] @ right.take(place[a:b], 0)
    return out


def gram_times(rows: DataFrame, rarity: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The Gram matrix of all rows of ``counted`` times ``right``."""
    shared = rows.sparkSession.sparkContext.broadcast((rarity, right))
    blocks = -(-len(rarity) // BLOCK)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, right = shared.value
        total = np.zeros((blocks * BLOCK, right.shape[1]))
        for batch in batches:
            ends, feature, w = sparse(batch.column(0), batch.column(1), rarity)
            left = products(ends, feature, w, right)
            order = np.argsort(feature.astype(np.min_scalar_type(len(total))), kind="stable")  # of short numbers: a radix sort
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            of_feature = np.append(0, np.cumsum(np.bincount(feature, minlength=len(total))))
            total += products(of_feature, row[order], w[order], left)
        total = total.reshape(blocks, -1)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i].tobytes() for i in some], pa.binary())], ["block", "sums"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[b] = held.get(b, 0) + np.frombuffer(raw.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "sums"])

    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # every task sends a whole matrix of sums, so their number does not grow with the rows
    parts = rows.select("features", "counts").coalesce(tasks).mapInArrow(partial, "block int, sums binary")
    out = np.zeros((blocks, BLOCK * right.shape[1]))
    for r in parts.repartition("block").mapInArrow(whole, "block int, sums binary").collect():  # one row for each block
        out[r.block] += np.frombuffer(bytes(r.sums))
    shared.unpersist()
    return out.reshape(blocks * BLOCK, -1)[: len(rarity)]


def frequencies(rows: DataFrame, n: int) -> np.ndarray:
    """How many rows of ``counted`` have each feature."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], ["f", "df"])

    out = np.zeros(n, np.int64)
    for r in rows.select("features").mapInArrow(partial, "f int, df long").groupBy("f").agg(F.sum("df").alias("df")).collect():  # n rows at most
        out[r.f] = r.df
    return out


def fit(texts: DataFrame, key: str, column: str, dims: int = DIMS, n: int = FEATURES, rounds: int = ROUNDS) -> Model:
    """The ``dims`` leading right singular vectors of all texts."""
    return fitted(stored(counted(features(texts, key, column, n)), "features"), dims, n, rounds)


def fitted(rows: DataFrame, dims: int = DIMS, n: int = FEATURES, rounds: int = ROUNDS) -> Model:
    """``fit`` for rows of ``counted``, which are read once a round."""
    rarity = np.log((rows.count() + 1) / (frequencies(rows, n) + 1)) + 1
    width = min(n, dims + EXTRA)
    right = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
    for _ in range(rounds):
        right = np.linalg.qr(gram_times(rows, rarity, right))[0]
    values, turn = np.linalg.eigh(right.T @ gram_times(rows, rarity, right))
    vectors = (right @ turn)[:, ::-1][:, :dims]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return Model(rarity, vectors, np.sqrt(np.maximum(values[::-1][:dims], 0)))


def embed(texts: DataFrame, key: str, column: str, model: Model) -> DataFrame:
    """(key, embedding, share): vectors of length 1 (zero for texts without terms), and the share of a text's weight that they hold."""
    return embedded(counted(features(texts, key, column, len(model.rarity))), key, model)


def embedded(rows: DataFrame, key: str, model: Model) -> DataFrame:
    """``embed`` for rows of ``counted``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = products(*sparse(batch.column(1), batch.column(2), m.rarity), m.vectors)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            x /= np.where(norm > 0, norm, 1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), pa.array(norm**2)], [key, "embedding", "share"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, embedding array<float>, share double")
