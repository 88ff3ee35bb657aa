"""Inverted lists with product-quantised residuals: nearest vectors without comparing all.

Centroids of the lists and code books of the residuals are fitted on a bounded sample (``SAMPLE`` rows by hash); every row is
then encoded and stored, ordered by list, so that a search reads the lists it needs and a list with a third of all rows
is cut into many files.  A search scores codes by table (inner product with the centroid, plus one number for each piece of
the residual), keeps the best of each task, and compares what is left exactly.

How many lists are probed and how many candidates are kept is found by :func:`tuned`: a bounded number of audit queries is
searched exactly, and both numbers grow until the wanted recall is reached.  With all lists probed and enough candidates the
search is the exact one, so some setting always reaches it.

Rows without an id or a vector are in no index; a vector's length must be that of the others."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import dense
from millrace.operators.stored import folder

#: Sample that centroids and code books are fitted on; most lists; pieces of a vector, and codes of a piece.
SAMPLE, LISTS, PIECES, CODES = 1 << 16, 4096, 16, 256
ROUNDS = 8
#: Queries that are searched exactly to set a search's effort, and the recall that they must have.
AUDIT, RECALL = 64, 0.95


@dataclass
class Books:
    """Centroids of lists, and for each piece (a slice of components) the codes of residuals."""

    centroids: np.ndarray
    pieces: list[tuple[int, int]]
    codes: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of rows: the nearest centroid, and the nearest code of each piece of what is left."""
        at = nearest(x, self.centroids)
        rest = x - self.centroids[at]
        return at, np.stack([nearest(rest[:, a:b], c) for (a, b), c in zip(self.pieces, self.codes, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codes, [query, piece, code]."""
        return np.stack([q[:, a:b] @ c.T for (a, b), c in zip(self.pieces, self.codes, strict=True)], axis=1)


@dataclass
class Index:
    """Encoded rows (list, vec_id, code) at ``path``, and how much of it a search goes through."""

    path: str
    books: Books
    probes: int
    keep: int


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of every row, in blocks."""
    half = np.einsum("ij,ij->i", centers, centers) / 2
    step = max(1, (1 << 22) // len(centers))
    return np.concatenate([np.argmin(half - x[a : a + step] @ centers.T, axis=1) for a in range(0, max(1, len(x)), step)])


def means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centers of ``k`` clusters of a sample; an empty one takes a row of the sample."""
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, centers)
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=k)
        some = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], axis=0)
        centers[some] = sums / count[some, None]
        gone = np.flatnonzero(count == 0)
        centers[gone] = x[rng.choice(len(x), len(gone))]
    return centers


def fit(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Books | None:
    """Books from the ``sample`` rows with the smallest hashes; None if there is no row."""
    got = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
    if not len(got):
        return None
    x = dense.matrix(got["embedding"].combine_chunks()).astype(np.float32)
    rng = np.random.default_rng(0)
    lists = lists or int(np.clip(np.sqrt(rows.count()), 1, LISTS))
    centroids = means(x, min(lists, len(x)), rng)
    rest = x - centroids[nearest(x, centroids)]
    bounds = np.linspace(0, x.shape[1], min(PIECES, x.shape[1]) + 1).astype(int).tolist()
    pieces = list(zip(bounds, bounds[1:], strict=False))
    return Books(centroids, pieces, [means(np.ascontiguousarray(rest[:, a:b]), min(CODES, len(x)), rng) for a, b in pieces])


def build(rows: DataFrame, path: str | None = None, lists: int | None = None, sample: int = SAMPLE) -> Index | None:
    """Fit, encode and store all rows (vec_id, embedding); None if there is none."""
    rows = rows.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    books = fit(rows, lists, sample)
    if books is None:
        return None
    spark = rows.sparkSession
    path = path or folder(spark, "vector-index")
    shared = spark.sparkContext.broadcast(books)  # lists and codes: bounded by LISTS and CODES

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, codes = shared.value.encode(dense.matrix(batch.column(1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "vec_id", "code"])

    encoded = rows.mapInArrow(encode, "list int, vec_id long, code binary")
    encoded.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id").write.parquet(path)
    return Index(path, books, len(books.centroids), 1)


def candidates(index: Index, ids: np.ndarray, q: np.ndarray, spark) -> DataFrame:
    """(query_id, vec_id): the ``keep`` best of each query by codes of the lists it probes."""
    books, keep = index.books, index.keep
    near = q.astype(np.float32) @ books.centroids.T
    probes = min(index.probes, near.shape[1])
    lists = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
    asked: dict[int, np.ndarray] = {}
    order = np.argsort(lists.ravel(), kind="stable")
    values, first = np.unique(lists.ravel()[order], return_index=True)
    for v, who in zip(values.tolist(), np.split(order // probes, first[1:]), strict=True):
        asked[v] = who
    shared = spark.sparkContext.broadcast((ids, near, asked, books.tables(q.astype(np.float32))))
    stored = spark.read.schema("list int, vec_id long, code binary").parquet(index.path)
    if len(asked) <= 512:
        stored = stored.where(F.col("list").isin(sorted(asked)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near, asked, tables = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        low = np.full(len(ids), -np.inf, np.float32)
        for batch in batches:
            at = batch.column(0).to_numpy()
            found = batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(at), -1) if len(at) else None
            for v in np.unique(at).tolist():
                who = asked.get(v)
                if who is None:
                    continue
                rows = np.flatnonzero(at == v)
                s = np.repeat(near[who, v][:, None], len(rows), 1)
                for p in range(code.shape[1]):
                    s += tables[who, p][:, code[rows, p]]
                i, j = np.nonzero((s >= low[who][:, None]) & (ids[who][:, None] != found[rows][None, :]))
                held = [np.concatenate(x) for x in zip(held, (who[i], found[rows[j]], s[i, j]), strict=True)]
                order = np.lexsort((-held[2], held[0]))
                held = [x[order] for x in held]
                first = np.searchsorted(held[0], np.arange(len(ids)))
                rank = np.arange(len(held[0])) - first[held[0]]
                full = np.diff(np.append(first, len(held[0]))) >= keep
                low[full] = held[2][first[full] + keep - 1]
                held = [x[rank < keep] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float32())], ["query_id", "vec_id", "approx"])

    found = stored.mapInArrow(score, "query_id long, vec_id long, approx float")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id"))
    return found.withColumn("n", best).where(F.col("n") <= keep).select("query_id", "vec_id")


def search(index: Index | None, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, place): about the ``k`` nearest other rows of each query (vec_id, embedding), compared exactly.

    Queries go to the workers in blocks, as in ``dense.nearest``."""
    spark = rows.sparkSession
    queries, rows = (x.where("vec_id is not null and embedding is not null").select("vec_id", "embedding") for x in (queries, rows))
    found = spark.createDataFrame([], "query_id long, vec_id long")
    n = max(1, -(-queries.count() // dense.QUERIES)) if index else 0
    for block in range(n):
        table = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).toArrow().combine_chunks()
        if len(table):
            found = found.unionByName(candidates(index, table["vec_id"].to_numpy(), dense.matrix(table["embedding"].combine_chunks()), spark))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    both = found.join(rows, "vec_id").join(q, "query_id")
    scored = both.select("query_id", "vec_id", F.round(vectors.dot(F.col("q"), F.col("embedding")), dense.DIGITS).alias("score")).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def tuned(index: Index | None, queries: DataFrame, rows: DataFrame, k: int, audit: int = AUDIT, want: float = RECALL) -> Index | None:
    """``index`` with the least effort that finds a ``want`` share of the ``k`` nearest rows of the audit queries."""
    if index is None:
        return None
    some = queries.where("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(audit)
    some = rows.sparkSession.createDataFrame(some.select("vec_id", "embedding").toArrow())
    pair = lambda df: {(r.query_id, r.vec_id) for r in df.select("query_id", "vec_id").collect()}  # noqa: E731  audit * k rows
    truth, lists = pair(dense.nearest(some, rows, k)), len(index.books.centroids)
    share, factor = 1 / 32, 8
    while True:
        tried = Index(index.path, index.books, max(1, int(np.ceil(lists * share))), k * factor)
        got = pair(search(tried, some, rows, k))
        if len(got & truth) >= want * len(truth):
            return tried
        if share < 1:
            share = min(1.0, share * 2)
        else:
            factor *= 4
