"""Nearest vectors of many query vectors, by comparing all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that go to the workers at once; each block is one scan of the rows.
QUERIES = 4096
#: Scores that a task has at once: what its memory holds, whatever the sizes of blocks and batches.
CELLS = 1 << 20
#: Scores are compared after rounding to so many digits.
DIGITS = 6


def rounded(x: np.ndarray) -> np.ndarray:
    """To ``DIGITS`` digits, halves away from zero."""
    y = np.abs(x) * 10.0**DIGITS
    low = np.floor(y)
    return np.copysign((low + (y - low >= 0.5)) / 10.0**DIGITS, x)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def tops(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of the first ``k`` rows (vec_id, embedding) of each query vector, by rounded score."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, vec_id, rounded score
    low = np.full(len(ids), -np.inf)  # of the k-th score so far, with room for rounding
    step = max(1, CELLS // len(ids))
    for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
        vec = batch.column(0).to_numpy()
        s = q @ matrix(batch.column(1)).T
        at, row = np.nonzero((s >= low[:, None]) & (ids[:, None] != vec[None, :]))
        if not len(at):
            continue
        at, found, score = (np.concatenate(x) for x in zip(held, (at, vec[row], rounded(s[at, row])), strict=True))
        order = np.lexsort((found, -score, at))
        at, found, score = at[order], found[order], score[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        held = at, found, score = at[keep], found[keep], score[keep]
        last = np.append(at[1:] != at[:-1], True)
        full = last & (np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
        low[at[full]] = score[full] - 10.0**-DIGITS
    yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2])], ["query_id", "vec_id", "score"])


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, place): the ``k`` other rows of the largest inner product with each query, ties by vec_id.

    Both sides have vec_id and embedding, vectors of one length; those without a vector are left out.  Every task
    keeps the first ``k`` rows of each query of a block, also of many equal ones: scores are rounded in it."""
    queries, rows = (x.where("vec_id is not null and embedding is not null").select("vec_id", "embedding") for x in (queries, rows))
    n = max(1, -(-queries.count() // QUERIES))
    parts = None
    for block in range(n):
        table = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).toArrow().combine_chunks()
        if not len(table):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((table["vec_id"].to_numpy(), matrix(table["embedding"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return tops(batches, *shared.value, k)

        part = rows.mapInArrow(run, "query_id long, vec_id long, score double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    return parts.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)
