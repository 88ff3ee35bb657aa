"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors of one label (and length) are dealt into shards of about ``SHARD`` by hash.  A task builds the graph of its
shard and then streams the queries through it: all vectors of the shard, and those of every later shard of the label, so
that every shard is searched for every pair of shards once, and links are the same from both sides.

Graph.  Levels are drawn geometrically; rows are sorted by them, so a layer is a prefix of the rows.  Layers are built from
the top, in batches: entries from the layer above, a beam search of ``BUILD`` in the graph so far, the batch's own vectors
beside it, neighbours chosen so that none is nearer to another chosen one, links back, and pruning where a row has more
than its slots.  All beams of a batch move side by side.

Search.  A beam whose last place is still a link is widened, twice each time, and beyond ``MOST`` the query is compared
with the whole shard, so dense groups are complete.  Before any query an audit sends ``AUDIT`` probes, rows turned by
noise to just above the limit, and compares what beams find with all of the shard; below ``RECALL`` the width doubles, and a
graph that fails at ``MOST`` is not used: its shard is compared in full.  What single precision puts near the limit is
verified in double precision on the given components.

Nothing here is a list of pairs outside a task: a vector's links are counted where they are found, a union-find inside the
shard leaves one edge for each row, and connected components of those edges are joined.  Equal vectors are one row with
a count, so the work is quadratic only in distinct vectors that all link with each other.

Defined cases: null labels, vectors that are null, empty, zero or hold null or non-finite components, and vectors of a length that no
other of the label has, link with nothing; equal vectors link with each other; repeated rows are vectors of their own; a
null id has links but is no component's name (null if a component has no other), and is not kept; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.neardup import components

NEAR = 0.93
#: Vectors of a shard.  A task holds one shard with its graph (about 1 KB a vector of 64 components).
SHARD = 1 << 17
#: Neighbours a row gets when it is added, those it keeps when its slots are full, and its slots.
LINKS, KEEP, SLOTS = 12, 24, 40
#: Beam widths: while building, of the first search, and the largest before a query is compared with the whole shard.
BUILD, FIRST, MOST = 32, 32, 128
#: Candidates that neighbours are chosen from, rows added at once, rows that begin a layer, queries at once.
CHOICE, BATCH, SEEDS, QUERIES = 32, 1024, 48, 1024
#: Probes of an audit, their cosine with the row they come from, and the share of links that must be found.
AUDIT, PROBE, RECALL = 256, 0.94, 0.99
#: What single precision may be off; cells of the visited table and of a block of comparisons.
SLACK, CELLS = 1e-4, 1 << 24
MINUS = np.float32(-np.inf)


class Graph:
    """Layers over rows of unit vectors (single precision), sorted by falling level."""

    def __init__(self, unit: np.ndarray, level: np.ndarray):
        self.unit, self.layers = unit, []
        for height in range(int(level.max()), -1, -1):
            self.layers.append(np.full((int((level >= height).sum()), SLOTS), -1, np.int32))
            self.grow(self.layers[-1])

    def grow(self, to: np.ndarray) -> None:
        """Fill the lowest layer."""
        n, above = len(to), len(self.layers[-2]) if len(self.layers) > 1 else 0
        used = np.zeros(n, np.int32)
        at = min(n, SEEDS)
        self.add(to, used, np.arange(at), np.zeros((at, 0), np.int32), np.zeros((at, 0), np.float32))
        while at < n:
            end = min(n, at + min(BATCH, max(16, at // 2)))
            if at < above < end:
                end = above
            q = self.unit[at:end]
            entries = self.descend(q, len(self.layers) - 1) if at >= above > 0 else np.zeros((end - at, 1), np.int32)
            self.add(to, used, np.arange(at, end), *self.beams(to, q, entries, BUILD))
            at = end

    def add(self, to: np.ndarray, used: np.ndarray, rows: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        """Link new rows with what their beams found and with each other."""
        q = self.unit[rows]
        own = q @ q.T
        np.fill_diagonal(own, MINUS)
        k = min(LINKS, len(rows) - 1)
        if k > 0:
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            found = np.concatenate((found, rows[near].astype(np.int32)), axis=1)
            sims = np.concatenate((sims, np.take_along_axis(own, near, 1)), axis=1)
        if not found.shape[1]:
            return
        chosen = self.diverse(found, sims, LINKS)
        width = chosen.shape[1]
        to[rows[:, None], np.arange(width)] = chosen
        used[rows] = (chosen >= 0).sum(1)
        src, dst = np.repeat(rows, width), chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        new = ~(to[dst] == src[:, None]).any(1)
        src, dst = src[new], dst[new]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        full = used[targets] + count > SLOTS
        place = np.arange(len(dst)) - np.repeat(first, count) + used[dst]
        fits = ~np.repeat(full, count)
        to[dst[fits], place[fits]] = src[fits]
        used[targets[~full]] += count[~full]
        self.prune(to, used, targets[full], first[full], count[full], src)

    def prune(self, to: np.ndarray, used: np.ndarray, targets: np.ndarray, first: np.ndarray, count: np.ndarray, src: np.ndarray) -> None:
        """Choose anew among the neighbours of rows whose slots are full and what is to be added to them."""
        for a in range(0, len(targets), 256):
            t, f, c = targets[a : a + 256], first[a : a + 256], count[a : a + 256]
            more = np.arange(c.max())
            extra = np.where(more < c[:, None], src[np.minimum(f[:, None] + more, len(src) - 1)], -1).astype(np.int32)
            cand = np.concatenate((to[t], extra), axis=1)
            sims = np.einsum("tcd,td->tc", self.unit[cand], self.unit[t])
            sims[cand < 0] = MINUS
            kept = self.diverse(cand, sims, KEEP)
            to[t] = -1
            to[t[:, None], np.arange(kept.shape[1])] = kept
            used[t] = (kept >= 0).sum(1)

    def diverse(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates of each row, nearest first, none nearer to an earlier one than to the row; half of
        the places are filled with the nearest of the others."""
        width = min(cand.shape[1], max(CHOICE, most + 8))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        out = np.empty((len(cand), min(most, width)), np.int32)
        for a in range(0, len(cand), 512):
            c, s = cand[a : a + 512], sims[a : a + 512]
            v = self.unit[c]
            each = v @ v.transpose(0, 2, 1)
            shut, kept, n = s == MINUS, np.zeros(c.shape, bool), np.zeros(len(c), np.int32)
            for j in range(width):
                take = ~shut[:, j] & (n < most)
                kept[:, j] = take
                n += take
                shut |= take[:, None] & (each[:, j] > s)
            places = np.argsort(~kept, axis=1, kind="stable")[:, : out.shape[1]]
            picked = np.take_along_axis(c, places, 1)
            real = np.take_along_axis(s, places, 1) > MINUS
            keep = np.take_along_axis(kept, places, 1) | (np.arange(out.shape[1]) < most // 2)
            out[a : a + 512] = np.where(real & keep, picked, -1)
        return out

    def descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        """Entries for the layer below the first ``layers`` ones."""
        entries = np.zeros((len(q), 1), np.int32)
        for to in self.layers[:layers]:
            entries = self.beams(to, q, entries, 2)[0][:, :1]
        return entries

    def beams(self, to: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the best ``width`` rows that each query's beam meets in a layer; -1 where there are fewer."""
        step = max(32, CELLS // (len(to) + 1))
        parts = [self.beam(to, q[a : a + step], entries[a : a + step], width) for a in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def beam(self, to: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        m, k = len(q), entries.shape[1]
        seen = np.zeros((m, len(to) + 1), bool)  # the last column is for empty slots
        ids, sims, open_ = np.full((m, width), -1, np.int32), np.full((m, width), MINUS), np.zeros((m, width), bool)
        ids[:, :k], open_[:, :k] = entries, True
        sims[:, :k] = np.einsum("mkd,md->mk", self.unit[entries], q)
        live = np.arange(m)
        seen[live[:, None], entries] = True
        while len(live):
            s = np.where(open_[live], sims[live], MINUS)
            best = s.argmax(1)
            go = s[np.arange(len(live)), best] > MINUS
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = False
            near = to[ids[live, best]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            r, c = np.nonzero(fresh)
            found = np.full(near.shape, MINUS)
            found[r, c] = np.einsum("ij,ij->i", self.unit[near[r, c]], q[live[r]])
            better = (found > sims[live].min(1)[:, None]).any(1)
            at, near, found = live[better], near[better], found[better]
            if not len(at):
                continue
            every = np.concatenate((sims[at], found), axis=1)
            top = np.argpartition(-every, width - 1, axis=1)[:, :width]
            sims[at] = np.take_along_axis(every, top, 1)
            ids[at] = np.take_along_axis(np.concatenate((ids[at], near), axis=1), top, 1)
            open_[at] = np.take_along_axis(np.concatenate((open_[at], found > MINUS), axis=1), top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[sims == MINUS] = -1
        return ids, sims


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, divided by their largest component so that no square overflows, and their norms."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


class Shard:
    """Rows of a shard: graph, links found so far by row, components of rows."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        n = len(nodes)
        rng = np.random.default_rng(n)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 6)
        order = np.argsort(-level, kind="stable")
        self.nodes, self.copies = nodes[order], copies[order]
        self.x, self.norm = scaled(vectors[order])
        self.unit = (self.x / self.norm[:, None]).astype(np.float32)
        self.links, self.root = np.zeros(n, np.int64), np.arange(n)
        self.graph, self.width = Graph(self.unit, level[order]), FIRST
        self.audit(rng)

    def audit(self, rng: np.random.Generator) -> None:
        """Set the first width to one that finds ``RECALL`` of what probes should find; 0 if none does."""
        rows = np.unique(np.linspace(0, len(self.unit) - 1, AUDIT).astype(np.int64))
        noise = rng.standard_normal((len(rows), self.unit.shape[1]))
        base = self.unit[rows].astype(np.float64)
        noise -= np.einsum("ij,ij->i", noise, base)[:, None] * base
        size = np.sqrt(np.einsum("ij,ij->i", noise, noise))[:, None]
        probes = PROBE * base + np.sqrt(1 - PROBE**2) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 1e-6)
        probes = (probes / np.sqrt(np.einsum("ij,ij->i", probes, probes))[:, None]).astype(np.float32)
        want = sum(len(r) for _, r in self.compared(probes))
        while self.width and sum(len(r) for _, r in self.near(probes)) < RECALL * want:
            self.width = self.width * 2 if self.width < MOST else 0

    def compared(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) that may be links, by comparing all, in blocks."""
        step = max(1, CELLS // max(1, len(self.unit)) // 4)
        for a in range(0, len(q), step):
            at, row = np.nonzero(q[a : a + step] @ self.unit.T >= NEAR - SLACK)
            yield at + a, row

    def near(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) that may be links; each query's in one block, from widened beams or the whole shard."""
        rest, width = np.arange(len(q)), self.width
        while len(rest) and 0 < width <= MOST:
            ids, sims = self.graph.beams(self.graph.layers[-1], q[rest], self.graph.descend(q[rest], len(self.graph.layers) - 1), width)
            full = sims[:, -1] >= NEAR - SLACK
            at, place = np.nonzero((sims >= NEAR - SLACK) & ~full[:, None])
            yield rest[at], ids[at, place]
            rest, width = rest[full], width * 2
        for at, row in self.compared(q[rest]):
            yield rest[at], row

    def verified(self, x: np.ndarray, norm: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which pairs reach the limit in double precision."""
        out = np.empty(len(at), bool)
        step = max(1, CELLS // 8 // x.shape[1])
        for a in range(0, len(at), step):
            i, j = at[a : a + step], row[a : a + step]
            out[a : a + step] = np.einsum("ij,ij->i", x[i], self.x[j]) / (norm[i] * self.norm[j]) >= NEAR
        return out

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put the rows of links into one component each."""
        while len(a):
            x, y = self.root[a], self.root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]

    def inside(self) -> None:
        """Links between rows of the shard, found from either side.

        A row whose beam was not full keeps its pairs (fewer than ``MOST``); for the others all rows are compared, and
        they give their pairs to rows of the first kind that missed them."""
        n, pairs, rest = len(self.nodes), [np.zeros(0, np.int64)], []
        whole = np.zeros(n, bool)
        for a in range(0, n, QUERIES):
            q = self.unit[a : a + QUERIES]
            width, open_ = self.width, np.arange(len(q))
            while len(open_) and 0 < width <= MOST:
                ids, sims = self.graph.beams(self.graph.layers[-1], q[open_], self.graph.descend(q[open_], len(self.graph.layers) - 1), width)
                full = sims[:, -1] >= NEAR - SLACK
                at, place = np.nonzero((sims >= NEAR - SLACK) & ~full[:, None])
                at, row = open_[at] + a, ids[at, place].astype(np.int64)
                ok = (at != row) & self.verified(self.x, self.norm, at, row)
                pairs.append(np.minimum(at, row)[ok] * n + np.maximum(at, row)[ok])
                open_, width = open_[full], width * 2
            rest.append(open_ + a)
        rest = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        whole[rest] = True
        for at, row in self.compared(self.unit[rest]):
            at = rest[at]
            ok = (at != row) & self.verified(self.x, self.norm, at, row)
            at, row = at[ok], row[ok]
            self.links += np.bincount(at, self.copies[row], n).astype(np.int64)
            self.join(at, row)
            other = ~whole[row]
            pairs.append(np.minimum(at, row)[other] * n + np.maximum(at, row)[other])
        found = np.unique(np.concatenate(pairs))
        for a in range(0, len(found), CELLS):
            x, y = found[a : a + CELLS] // n, found[a : a + CELLS] % n
            self.links += np.bincount(x, self.copies[y] * ~whole[x], n).astype(np.int64) + np.bincount(y, self.copies[x] * ~whole[y], n).astype(np.int64)
            self.join(x, y)

    def foreign(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Links of rows of other shards: (nodes that have some, how many, a row of this shard for each)."""
        x, norm = scaled(vectors)
        links, first = np.zeros(len(nodes), np.int64), np.full(len(nodes), -1)
        for at, row in self.near((x / norm[:, None]).astype(np.float32)):
            ok = self.verified(x, norm, at, row)
            at, row = at[ok], row[ok]
            links += np.bincount(at, self.copies[row], len(nodes)).astype(np.int64)
            self.links += np.bincount(row, copies[at], len(self.nodes)).astype(np.int64)
            head, where = np.unique(at, return_index=True)
            new = first[head] < 0
            first[head[new]] = row[where[new]]
            self.join(first[at], row)
        some = np.flatnonzero(links)
        return nodes[some], links[some], self.nodes[first[some]]


OUT = ["node", "links", "other"]


def found_rows(nodes: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, links, other)], OUT)


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, links, other) of sorted rows (part, shard, kind, node, copies, vector): each shard's rows (kind 0), then the
    queries to it (kind 1); ``other`` is a node of the same component, or the node itself."""
    key, shard, held, size, empty = None, None, [], 0, False

    def taken() -> tuple[np.ndarray, ...]:
        nonlocal held, size
        out = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held, size = [], 0
        return out

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        if held and shard is not None:
            yield found_rows(*shard.foreign(*taken()))
        elif held:
            shard = Shard(*taken())
            shard.inside()
        if shard is not None:
            yield found_rows(shard.nodes, shard.links, shard.nodes[shard.root])
        shard = None

    for batch in batches:
        if not batch.num_rows:
            continue
        part, number, kind, nodes, copies = (batch.column(i).to_numpy() for i in range(5))
        edges = np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True):
            if key != (part[a], number[a]):
                yield from done()
                key = (part[a], number[a])
                empty = bool(kind[a])  # no row fell into this shard
            elif kind[a] and shard is None and not empty:
                shard = Shard(*taken())
                shard.inside()
            if empty:
                continue
            vectors = batch.column(5).slice(a, b - a)
            held.append((nodes[a:b], copies[a:b], vectors.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)))
            size += b - a
            if shard is not None and size >= QUERIES:
                yield found_rows(*shard.foreign(*taken()))
    yield from done()


def links(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.when(fit, F.col("embedding")).alias("embedding"))
    same = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = common.materialize(same.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")), "vec-nodes")
    # One row for each label and length: its number, and over how many shards it is dealt.
    parts = nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("part")).where("n > 1")
    parts = common.small(common.materialize(parts.select("label", "dims", "part", F.ceil(F.col("n") / shard).cast("int").alias("shards")), "vec-parts"))
    mine = nodes.join(parts, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    dealt = mine.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("kind", (F.col("shard") < F.col("own")).cast("int"))
    dealt = dealt.repartition("part", "shard").sortWithinPartitions("part", "shard", "kind", "node")
    found = dealt.select("part", "shard", "kind", "node", "copies", "embedding").mapInArrow(common.tidy(search), "node long, links long, other long")
    found = common.materialize(found, "vec-links")
    group = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"key": "node", "label": "group"})
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "label", "embedding", "copies", "least").join(counts, "node", "left").join(group, "node", "left")
    known = known.withColumn("group", F.coalesce("group", "node"))
    named = known.groupBy("group").agg(F.min("least").alias("component"))
    known = known.join(named, "group").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.join(common.materialize(known, "vec-known"), ["label", "embedding"], "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op12_vectors(spark, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all embeddings."""
    common.prepare(spark)
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: coalesce(CAST(x AS DOUBLE), 0)) AS e,
  label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit FROM embeddings),
f AS (SELECT rid, label, e, len(e) AS n, sqrt(list_inner_product(e, e)) AS norm FROM (SELECT rid, label, CASE WHEN fit THEN e END AS e FROM v) WHERE e IS NOT NULL),
p AS (SELECT x.rid AS a, y.rid AS b FROM f x JOIN f y ON x.label = y.label AND x.n = y.n AND x.rid <> y.rid AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= {NEAR}),
r(rid, m) AS (SELECT rid, vec_id FROM v UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.rid),
c AS (SELECT rid, min(m) AS m FROM r GROUP BY rid), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.m AS component_id, coalesce(vec_id = c.m, false) AS kept FROM v JOIN c ON v.rid = c.rid LEFT JOIN n ON v.rid = n.a"""
