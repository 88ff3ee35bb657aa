"""Plain Lloyd clustering of vectors in integers.

Components become integers, floor(``SCALE`` * x).  The ``K`` first centroids are the kept vectors with the smallest
SHA-256 of "1:" and their id.  Every round broadcasts the centroids (``K`` rows of ``DIMS`` numbers, whatever the
table's size); tasks compare their vectors with each centroid by integer squared differences, take the lowest index
of the least distance and return the integer sums and counts of their partition, so ``K`` rows leave a task and a
round is one scan; the sums meet in a groupBy.  An average is the exact floor of sum / count; empty centroids stay.

Everything is exact: results do not depend on how rows are dealt, and reruns agree.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out; a null id
counts as an empty string in the hash; repeated rows are vectors of their own, and where they have one hash the smaller
embedding comes first; with fewer than ``K`` kept vectors each is a centroid; no kept vector gives an empty result;
ties of the distance go to the smaller number; components beyond ``LARGEST`` (after scaling) are an error, as distances might
not fit into 64 bits then; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Largest integer component: squared differences of vectors of ``DIMS`` such components add up to less than 2^63.
LARGEST = 1 << 27


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where((F.size("embedding") == dims) & F.forall("embedding", number)).select("vec_id", "embedding")


def integers(column) -> np.ndarray:
    """Rows of integer components of a series of vectors."""
    x = np.floor(np.stack(column.to_numpy()).astype(np.float64) * SCALE)
    if np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}: distances may not fit into 64 bits")
    return x.astype(np.int64)


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row."""
    d = np.empty((len(centroids), len(x)), np.int64)
    for k, c in enumerate(centroids):
        diff = x - c
        d[k] = np.einsum("ij,ij->i", diff, diff)
    nearest = d.argmin(0)
    return nearest, d[nearest, np.arange(len(x))]


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes, in their order (a bounded top-k)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "embedding").orderBy("h", "embedding").limit(k).toPandas()
    return integers(rows["embedding"]) if len(rows) else np.zeros((0, 0), np.int64)


def averages(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of one more round."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
        for frame in frames:
            if len(frame):
                x = integers(frame["embedding"])
                nearest, _ = assigned(x, shared.value)
                np.add.at(total, nearest, x)
                count += np.bincount(nearest, minlength=len(count))
        some = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "sums": list(total[some])})

    parts = vectors.select("embedding").mapInPandas(sums, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in cells.collect():  # K * DIMS rows at most
        out[r.cluster, r.j] = r.s // r.n
    shared.unpersist()
    return out


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = kept(vectors, dims)
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = averages(rows, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                nearest, distance = assigned(integers(frame["embedding"]), shared.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": nearest.astype(np.int32), "distance": distance})

    placed = common.materialize(rows.mapInPandas(place, "vec_id long, cluster int, distance long"), "lloyd")
    # One row for each centroid, at most ``k``.
    sums = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    about = [(i, sums[i], total, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids) if i in sums]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op13_lloyd(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    common.prepare(spark)
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def _sql() -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e, embedding AS raw, sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h
FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, raw) - 1 AS c, e FROM v ORDER BY h, raw LIMIT {K})",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"d{k} AS (SELECT v.rid, c, list_sum(list_transform(list_zip(v.e, c{k}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{k})")
        parts.append(f"a{k} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS r FROM d{k}) WHERE r = 1)")
        if k < ROUNDS:
            parts.append(f"x{k} AS (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{k} JOIN v ON a{k}.rid = v.rid)")
            parts.append(f"s{k} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM x{k} GROUP BY c, j) GROUP BY c)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(s{k}.e, c{k}.e) AS e FROM c{k} LEFT JOIN s{k} ON c{k}.c = s{k}.c)")
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a{last}.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{last}.e, ',')) AS centroid_sha256
FROM a{last} JOIN v ON a{last}.rid = v.rid JOIN c{last} ON a{last}.c = c{last}.c"""


OP13_SQL = _sql()
