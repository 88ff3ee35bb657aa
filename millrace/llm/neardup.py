"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Elements are runs of ``RUN`` words with the number of times they occur: an element of weight c is c unit
regions on the weight axis.  Darts are thrown, by hashes of the region, at cells of the rank axis until a
document's expected number of darts is enough for all coordinates; every coordinate keeps its earliest
dart.  Two documents agree on a coordinate with a probability of their weighted Jaccard similarity.

Equal documents are merged first (a digest of the words).  Bands of coordinates put the others into
buckets.  Links are found without pairing whole buckets:

1. every member of a bucket is compared with the bucket's most central member, the one with most company in
   its buckets; the pairs whose signatures agree well enough make loose groups, and each document's best pair
   is verified;
2. inside a loose group that the verified links do not connect, an exact prefix filter finds all documents that
   can still be linked: in the order of rarity two documents of the required similarity have one of their first
   elements in common, at positions and with sizes that leave room for the required overlap.  Those are
   compared in blocks, on whole sets;
3. between loose groups, members of a bucket are compared by signature.  A bucket of more than ``SPLIT`` members
   that is nearly one loose group is dealt into groups of these with all others.  In a bucket of many groups (a
   passage that many documents share) members meet under each two such buckets they have in common, within
   classes of size: two documents of a similarity of 0.8 or more share another bucket almost surely, documents
   with only a passage in common seldom do.  What is still larger is dealt into blocks, each pair of which is
   compared, so no group is too large.

Every pair that is found is verified on whole documents.  Components of the verified links are the classes.

Defined cases: texts without words are equal if they are the same string (null counts as empty); texts of
fewer than ``RUN`` words have one element; very long texts are compared whole; among central members of equal company the
smallest key is taken, which changes no class; repeated rows are copies; the class of a document is the smallest id
in it (null only if all ids are); an empty table gives an empty result; further columns are ignored by
``classes`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.llm import common, tokens

RUN, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Coordinates that must agree before a pair is verified: five standard deviations below what 0.8 gives.
AGREE = 57
#: Darts of a document on average (none of the coordinates stays empty but for one document in 150, which throws on).
DARTS = COORDINATES * (np.log(COORDINATES) + 5)
#: The rank axis below 1 is cut in octaves from here; above it cells have the width 1.
OCTAVES = 6
SPLIT = 64


def units(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the unit regions of each text, and where each text's begin."""
    h, first = tokens.windows(w, RUN)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    times = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return tokens.mixed(h + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first


def poisson_darts(h: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(position, number) of each dart of cells with hashes ``h`` and area ``width``."""
    u = (h >> np.uint64(11)).astype(np.float64) / (1 << 53)
    p = total = np.exp(-width)
    count = np.zeros(len(h), np.int64)
    left = np.flatnonzero(u >= total)
    k = 0
    while len(left) and k < 40:
        k += 1
        count[left] = k
        p = p * width / k
        total = total + p
        left = left[u[left] >= total]
    at = np.repeat(np.arange(len(h)), count)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def thrown(elements: np.ndarray, cells: np.ndarray, low: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, rank, hash) of the darts in one cell of each element."""
    h = tokens.mixed(elements ^ tokens.mixed(cells.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
    at, number = poisson_darts(h, width)
    dart = tokens.mixed(h[at] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    return at, low[at] + width * ((dart >> np.uint64(40)).astype(np.float64) / (1 << 24)), tokens.mixed(dart + np.uint64(1))


def signatures(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Earliest dart of every coordinate of each text [n, COORDINATES]; zeros for texts without elements."""
    n = len(first) - 1
    out = np.zeros((n, COORDINATES), np.uint64)
    todo, reach = np.flatnonzero(np.diff(first) > 0), DARTS
    while len(todo):
        sizes = np.diff(first)[todo]
        index = np.repeat(first[todo] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        e, text = elements[index], np.repeat(np.arange(len(todo)), sizes)
        until = (reach / sizes)[text]
        parts = []
        edges = [0.0, *(2.0**k for k in range(-OCTAVES, 1))]
        for c in range(len(edges) - 1):
            use = np.flatnonzero(until > edges[c])
            at, rank, dart = thrown(e[use], np.full(len(use), c), np.full(len(use), edges[c]), edges[c + 1] - edges[c])
            parts.append((text[use[at]], rank, dart))
        more = np.maximum(0, np.ceil(until).astype(np.int64) - 1)
        rep = np.repeat(np.arange(len(e)), more)
        unit = np.arange(len(rep)) - np.repeat(np.cumsum(more) - more, more) + 1
        at, rank, dart = thrown(e[rep], len(edges) + unit, unit.astype(np.float64), 1.0)
        parts.append((text[rep[at]], rank, dart))
        text, rank, dart = (np.concatenate(x) for x in zip(*parts, strict=True))
        slot = text * COORDINATES + ((dart >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        got = np.zeros(len(todo) * COORDINATES, np.uint64)
        got[slot[order]] = dart[order] | np.uint64(1)  # the earliest is written last
        got = got.reshape(len(todo), COORDINATES)
        full = (got > 0).all(1)
        out[todo[full]] = got[full]
        todo, reach = todo[~full], 2 * reach
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Bucket numbers [n, BANDS]."""
    h = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    parts = signature.reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r]
    return tokens.mixed(h).astype(np.int64)


def digest_of(w: tokens.Words, i: int, text) -> bytes:
    """Names a text by its words themselves, or by the whole string if it has none."""
    some = w.first[i + 1] > w.first[i]
    return hashlib.blake2b(w.content(i) if some else b"\0" + (text.as_py() or "").encode(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, signature, buckets) for each document; 16 bits of each coordinate are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            digests, counts, low, buckets = [], [], [], []
            for at, w in tokens.pieces(batch.column(1)):
                e, first = units(w)
                s = signatures(e, first)
                n = np.diff(first)
                digests += [digest_of(w, i, batch.column(1)[at + i]) for i in range(len(n))]
                counts.append(n)
                low += [x.tobytes() for x in (s >> np.uint64(8)).astype(np.uint16)]
                buckets += [x if k else [] for x, k in zip(bands(s).tolist(), n.tolist(), strict=True)]
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digests, pa.binary()), pa.array(np.concatenate(counts), pa.int64()), pa.array(low, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                    ["doc_id", "digest", "n", "signature", "buckets"],
                )

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, digest binary, n long, signature binary, buckets array<long>")


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) that agree on enough coordinates, and on how many."""
    s = reps.select("key", "signature")
    both = pairs.join(s.withColumnsRenamed({"key": "a", "signature": "x"}), "a").join(s.withColumnsRenamed({"key": "b", "signature": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, COORDINATES) for i in (2, 3))
                same = (x == y).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], ["a", "b", "same"]).filter(pa.array(same >= AGREE))

    return both.select("a", "b", "x", "y").mapInArrow(common.tidy(run), "a long, b long, same long")


def element_sets(docs: DataFrame, reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, elements): the sorted units (32 bits each) of the documents behind ``keys``."""
    wanted = reps.join(keys, "key", "left_semi").select("key", "digest", "doc_id")
    chosen = common.small(wanted)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, F.col("id").eqNullSafe(chosen["doc_id"])).select("key", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            keep, sets = [], []
            for at, w in tokens.pieces(batch.column(2)):
                e, first = units(w)
                short = (e >> np.uint64(32)).astype(np.uint32)
                for i in range(len(first) - 1):
                    # Rows that share an id but not the text are other documents.
                    if digest_of(w, i, batch.column(2)[at + i]) == batch.column(1)[at + i].as_py():
                        keep.append(at + i)
                        sets.append(np.sort(short[first[i] : first[i + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], ["key", "elements"])

    return common.materialize(texts.mapInArrow(common.tidy(run), "key long, elements binary").dropDuplicates(["key"]), "dup-elements")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is high enough, on whole documents."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = element_sets(docs, reps, keys)
    both = pairs.join(sets.withColumnsRenamed({"key": "a", "elements": "x"}), "a").join(sets.withColumnsRenamed({"key": "b", "elements": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                lower, upper = min(len(a), len(b)), max(len(a), len(b))
                common_units = overlap(a, b) if lower >= SIMILAR * upper else 0
                keep.append(common_units >= SIMILAR * (len(a) + len(b) - common_units) - 1e-9 and upper > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.materialize(both.select("a", "b", "x", "y").mapInArrow(common.tidy(run), "a long, b long"), "dup-links")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    both = np.concatenate((a, b))
    u, counts = np.unique(both, return_counts=True)
    if len(u) == len(both):
        return 0
    x = np.searchsorted(a, u, "right") - np.searchsorted(a, u)
    return int(np.minimum(x, counts - x).sum())


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key that the links connect a key with.

    Labels spread along links and jump to their label's label, so rounds are few; each is written out."""
    both = common.materialize(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "cc-links")
    labels = common.materialize(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = common.materialize(spread.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "cc-labels")
        if new.where("old <> label").isEmpty():
            return new.select("key", "label")
        labels = new.select("key", "label")


def with_mixed(members: DataFrame) -> DataFrame:
    """Members (key, label, size, bucket) of buckets with several labels, with the bucket's ``count``, its most
    frequent label ``big`` and how many members have ``others``."""
    by_label = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    groups = by_label.groupBy("bucket").agg(F.sum("c").alias("count"), F.max(F.struct("c", "label")).alias("most"))
    groups = groups.select("bucket", "count", F.col("most.label").alias("big"), (F.col("count") - F.col("most.c")).alias("others")).where("others > 0")
    return common.materialize(members.join(groups, "bucket"), "dup-members")


def dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups to compare within, as key, label, bucket; members of buckets that are too mixed for that).

    A small bucket is a group.  A large one whose members nearly all have one label is dealt into groups of
    those, each with all of the others: what has one label need not be compared with itself."""
    small = members.where(F.col("count") <= SPLIT).select("key", "label", "bucket")
    wide = members.where((F.col("count") > SPLIT) & (F.col("others") <= SPLIT)).withColumn("n", F.ceil(F.col("count") / SPLIT))
    own = F.array(F.pmod(F.xxhash64("key", "bucket"), F.col("n")))
    blocks = F.when(F.col("label") == F.col("big"), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    shared = wide.select("key", "label", "bucket", F.explode(blocks).alias("block")).select("key", "label", F.xxhash64("bucket", "block").alias("bucket"))
    return small.unionByName(shared), members.where((F.col("count") > SPLIT) & (F.col("others") > SPLIT))


def stars(reps: DataFrame) -> DataFrame:
    """(a, b): members of buckets and the most central member of each."""
    members = reps.select("key", F.explode("buckets").alias("bucket"))
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared = common.materialize(members.join(counts, "bucket"), "dup-shared")
    central = shared.groupBy("key").agg(F.sum("count").alias("company"))
    heads = shared.join(central, "key").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("key")).alias("k"))).alias("h")).select("bucket", (-F.col("h.k")).alias("head"))
    return shared.join(heads, "bucket").where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()


def links_inside(docs: DataFrame, reps: DataFrame, tight: DataFrame, loose: DataFrame) -> DataFrame:
    """Links (a, b) that connect similar documents of different tight labels in one loose group; exact.

    With elements in one order, rare ones first, p elements of a document of n before the first common one
    leave an overlap of n - p at most; similarity s to a document of m needs s / (1 + s) * (n + m).  So m is at
    most (1 + s) / s * (n - p) - n.  The larger document of a pair looks for such sizes, in classes of 2 %; only
    documents that meet another label this way are compared, on whole sets and in blocks."""
    split = loose.join(tight, "key", "left").select("key", F.col("group"), F.coalesce("label", "key").alias("label"))
    open_groups = split.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("group")
    work = common.materialize(split.join(open_groups, "group"), "dup-open")
    sets = element_sets(docs, reps, work.select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in batch.column(3)]
            n = np.array([len(x) for x in parts], np.int64)
            at = np.repeat(np.arange(len(parts)), n)
            take = pa.array(at)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            for i in range(0, len(flat), 100_000):
                k = take.slice(i, 100_000)
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(k) for j in range(3)), pa.array(n[at[i : i + 100_000]]), pa.array(flat[i : i + 100_000])], ["key", "group", "label", "n", "h"])

    each = work.join(sets, "key").select("key", "group", "label", "elements").mapInArrow(common.tidy(run), "key long, group long, label long, n long, h long")
    each = common.materialize(each, "dup-units")
    frequent = each.groupBy("group", "h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = each.join(frequent, ["group", "h"])
    w = Window.partitionBy("key")
    position = F.col("n") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("df", "h")) - 1
    ratio = (1 + SIMILAR) / SIMILAR
    first = known.withColumn("p", position).where(F.col("p") <= (1 - SIMILAR) * F.col("n") + 1e-6).withColumn("most", ratio * (F.col("n") - F.col("p")) - F.col("n") + 1e-6)
    size = lambda x: F.floor(F.log(x) / F.log(F.lit(1.02)))
    smaller = first.where("most >= n").select("key", "group", "label", "n", "p", "h", size(F.col("n")).alias("class"), F.lit(False).alias("seeks"))
    least, top = F.greatest(F.ceil(SIMILAR * F.col("n") - 1e-6), F.lit(1)), F.least(F.floor("most"), F.col("n"))
    larger = first.where(least <= top).select("key", "group", "label", "n", "p", "h", F.explode(F.sequence(size(least), size(top))).alias("class"), F.lit(True).alias("seeks"))
    rows = smaller.unionByName(larger)
    mixed = rows.groupBy("group", "h", "class").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("seeks").alias("s"), F.max("seeks").alias("t")).where("x <> y and not s and t").select("group", "h", "class")
    # Documents that meet another label there are compared in blocks: block i meets every block j >= i of its group.
    left = common.materialize(rows.join(mixed, ["group", "h", "class"]).select("key", "group", "label").distinct(), "dup-left")
    sizes = left.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = left.join(sizes, "group").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "label", F.xxhash64("group", F.least("block", "with"), F.greatest("block", "with")).alias("bucket"))
    groups = dealt.join(sets, "key").groupBy("bucket").agg(F.collect_list(F.struct("key", "label", "elements")).alias("m"))  # bounded by 2 * SPLIT, about

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for members in batch.column(0):
                m = members.values
                out += spanning_links(m.field("key").to_pylist(), m.field("label").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint32) for x in m.field("elements")])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return common.materialize(groups.select("m").mapInArrow(common.tidy(compare), "a long, b long").distinct(), "dup-links")


def spanning_links(keys: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Similar pairs of different labels, as few as connect what all such pairs connect."""
    n = np.array([len(x) for x in sets])
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    for at in range(0, len(every), 20_000):  # columns of the table of documents by elements
        low, high = np.searchsorted(where, [at, at + 20_000])
        x = np.zeros((len(sets), 20_000), np.float32)
        x[owner[low:high], where[low:high] - at] = 1
        shared += x @ x.T
    similar = shared >= SIMILAR * (n[:, None] + n[None] - shared) - 1e-6
    root = {label: label for label in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            root[x] = y
            out.append((keys[i], keys[j]))
    return out


def remaining_pairs(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels in a common bucket that agree on enough coordinates (step 3)."""
    labelled = reps.join(labels, "key", "left").select("key", F.col("n").alias("size"), "buckets", F.coalesce("label", "key").alias("label"))
    first, wide = dealt(with_mixed(labelled.select("key", "label", "size", F.explode("buckets").alias("bucket"))))
    # Similar documents share more buckets than one.  If one of them is no wide one they meet there; else they
    # meet under each two of their wide buckets, and their sizes are in the same or neighbouring classes.
    several = wide.groupBy("key", "label", F.col("size")).agg(F.array_sort(F.collect_list("bucket")).alias("b"))
    two = several.select("key", "label", "size", F.posexplode("b").alias("i", "x"), "b").select("key", "label", "size", "x", F.explode(F.slice(F.col("b"), F.col("i") + 2, F.size("b"))).alias("y"))
    size_class = F.floor(F.log(F.col("size")) / F.log(F.lit(1 / SIMILAR)))
    two = two.withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    second, wide = dealt(with_mixed(two.select("key", "label", "size", F.xxhash64("x", "y", "class").alias("bucket"))))
    # Blocks of what is still large: block i meets every block j >= i in a group of its own.
    n = F.ceil(F.col("count") / (SPLIT // 2))
    block = F.pmod(F.xxhash64("key", "bucket"), n)
    third = wide.withColumn("n", n).withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    third = third.select("key", "label", F.xxhash64("bucket", F.least("block", "with"), F.greatest("block", "with")).alias("bucket"))
    every = first.unionByName(second).unionByName(third)
    groups = every.join(reps.select("key", "signature"), "key").groupBy("bucket").agg(F.collect_list(F.struct("key", "label", "signature")).alias("m"))  # bounded by 2 * SPLIT, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            lists, first = batch.column(0), batch.column(0).offsets.to_numpy()
            key, label = (lists.values.field(f).to_numpy() for f in ("key", "label"))
            s = np.frombuffer(b"".join(lists.values.field("signature").to_pylist()), np.uint16).reshape(-1, COORDINATES)
            for i in range(len(batch)):
                at = slice(first[i], first[i + 1])
                k, g, x = key[at], label[at], s[at]
                agree = (x[:, None] == x[None]).sum(2) >= AGREE if len(x) <= 512 else np.stack([(x == row).sum(1) for row in x]) >= AGREE
                a, b = np.nonzero(agree & (g[:, None] < g[None]))
                found.append(np.stack([k[a], k[b]], 1))
            every = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["a", "b"])

    return common.materialize(groups.select("m").mapInArrow(common.tidy(run), "a long, b long").distinct(), "dup-pairs")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id, class_digest): the class's smallest (id, digest) for every document."""
    base = common.materialize(sketches(docs), "dup-sketches")
    reps = base.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("buckets").alias("buckets"))
    reps = common.materialize(reps.withColumn("key", F.monotonically_increasing_id()), "dup-texts")
    attached = common.materialize(agreeing(common.materialize(stars(reps), "dup-stars"), reps), "dup-attached")
    best = attached.groupBy("a").agg(F.max(F.struct("same", F.col("b"))).alias("m")).select("a", F.col("m.b").alias("b"))
    links = verified(common.materialize(best, "dup-pairs"), docs, reps)
    tight = components(links)
    loose = components(attached.select("a", "b"))
    inside = links_inside(docs, reps, tight, loose.withColumnRenamed("label", "group"))
    between = verified(remaining_pairs(reps, loose), docs, reps)
    labels = components(links.union(inside).union(between))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    named = reps.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    heads = named.groupBy("label").agg(least.alias("least")).select("label", F.col("least.doc_id").alias("class_id"), F.col("least.digest").alias("class_digest"))
    by_text = common.materialize(named.select("digest", "label").join(heads, "label").select("digest", "class_id", "class_digest"), "dup-classes")
    return base.select("doc_id", "digest").join(by_text, "digest")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every document."""
    return grouped(docs).select("doc_id", "class_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that with the smallest id.

    Dropped ids go to the documents, not the documents to the ids.  Rows whose id is null or repeated are told
    apart by their texts."""
    found = common.materialize(grouped(docs), "dup-found")
    repeated = common.materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "dup-repeated")
    dropped = common.small(found.where("not (doc_id <=> class_id) or not (digest <=> class_digest)").select("doc_id").where("doc_id is not null").distinct())
    twice = common.small(repeated.where("doc_id is not null"))
    single = docs.where("doc_id is not null").join(dropped, "doc_id", "left_anti").join(twice, "doc_id", "left_anti")
    unclear = docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").join(twice, "doc_id", "left_semi"))

    # Whole rows in one column: no name of theirs meets one of ours.
    packed = unclear.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            texts = batch.column("text")
            digests = [digest_of(w, i, texts[at + i]) for at, w in tokens.pieces(texts) for i in range(len(w.first) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(digests, pa.binary())], ["row", "id", "digest"])

    schema = StructType([packed.schema["row"], packed.schema["id"], StructField("digest", BinaryType())])
    heads = found.select("class_id", "class_digest").distinct()
    marked = packed.mapInArrow(common.tidy(run), schema)
    kept = marked.join(heads, F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest")), "left_semi").dropDuplicates(["id", "digest"])
    return single.unionByName(kept.select("row.*"))


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document with the class of its near-duplicates."""
    common.prepare(spark)
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
