"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

The stream of every source is its documents in a hashed order, cut into blocks of equally many tokens
(the last one may be short).  Slot i of the schedule belongs to the source whose stretch of the
cumulative shares holds the golden-ratio point frac(i * phi); the slots of a source are ranked,
and rank r takes block r modulo the source's blocks.  A document's ``taken`` is its share of all blocks
that slots took.

Blocks of all sources have one size, but a source of fewer than ``LEAST_BLOCKS`` such blocks has smaller ones of its
own, and accordingly more slots, so that small sources come as near to their targets as large ones.  Shares are
targets counted in blocks.  The SQL twin says the same rows, for small sources too.

Everything is DataFrame operations: positions are range-partitioned running totals, so neither a source
with most of the rows nor one with few makes a large task, and sources are rows of a table, however many.

Defined cases: a null text has 0 tokens; documents of 0 tokens take 0; a source without tokens has target
0; null is a source of its own (ordered last); repeated rows are separate documents; a null id is hashed
as an empty string; ties of that hash are ordered by size and id; very long texts span many blocks; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: The golden ratio's fractional part, and how many slots the schedule has at least (blocks are at most BLOCK tokens).
PHI, SLOTS, BLOCK = 0.6180339887498949, 65_536, 65_536
#: A source has at least so many blocks, if it has so many tokens.
LEAST_BLOCKS = 64
TOKEN = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, pos, target): shares of all tokens by weight, none above ``repeats`` times its size.

    Sources that stop at their limit are those with the lowest limit to weight ratio; with c of them
    stopped the rest share what remains by weight, so one pass over prefix sums finds the level.
    ``sizes`` has one row per source."""
    pick = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").isNull(), "source")
    t = sizes.withColumn("pos", F.row_number().over(order)).withColumn("w", F.element_at(pick, ((F.col("pos") - 1) % len(weights) + 1).cast("int")))
    t = t.where("source_size > 0").withColumn("limit", F.lit(repeats) * F.col("source_size")).withColumn("ratio", F.col("limit").cast("double") / F.col("w"))
    by, every = Window.orderBy("ratio", "pos"), Window.partitionBy(F.lit(1))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    t = t.withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # Stopped: the level that would hold if this source and all later ones were free is above its ratio.
    t = t.withColumn("stopped", F.col("rest").cast("double") / F.col("left") > F.col("ratio"))
    level = F.min(F.when(~F.col("stopped"), F.struct("ratio", "pos", (F.col("rest").cast("double") / F.col("left")).alias("level")))).over(every)["level"]
    t = t.withColumn("target", F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(F.col("w") * level))
    zero = sizes.where("source_size = 0").select("source", "source_size", F.lit(None).cast("int").alias("pos"), F.lit(0.0).alias("target"))
    return t.select("source", "source_size", "pos", "target").unionByName(zero)


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(sized documents with source_size and target, table of sources, tokens of a block of a large source)."""
    base = common.materialize(docs.select("doc_id", "source", tokens(F.col("text")).alias("size")), "mix-sizes")
    table = common.materialize(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    return base, table, max(1, min(BLOCK, total // SLOTS))


def own_block(block: int) -> Column:
    """Tokens of a block of the source of ``source_size`` tokens."""
    return F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")


def schedule(table: DataFrame, block: int) -> DataFrame:
    """Slots (slot, source position, rank): one for each ``block`` tokens of all, more for sources with smaller blocks, none above the limit of repeats.

    Ranks come from counts of the slots of each source in groups of consecutive slots."""
    spark = table.sparkSession
    live = table.where("target > 0").withColumn("own", own_block(block)).withColumn("blocks", F.ceil(F.col("source_size") / F.col("own")))
    # A target in blocks of the source (the short last one counts in their mean), times ``block``.
    share = F.when(F.col("own") == block, F.col("target")).otherwise(F.col("target") / F.col("source_size") * F.col("blocks") * block)
    live = live.withColumn("share", share)
    order, every = Window.orderBy("pos"), Window.partitionBy(F.lit(1))
    hi = F.sum("share").over(order) / F.sum("share").over(every)
    edges = live.withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn("open", F.col("pos") == F.max("pos").over(every))
    edges = common.materialize(edges.select("pos", "blocks", "lo", "hi", "open", (F.col("share") - F.col("target")).alias("more")), "mix-edges")
    more = edges.agg(F.sum("more")).first()[0]
    if more is None:
        return spark.createDataFrame([], "slot long, pos int, blocks long, rank long")
    n = -(-(int(table.agg(F.sum("source_size")).first()[0]) + round(more)) // block)
    # A slot meets the sources whose stretches touch its cell of n; cells hold about one point each.
    cell = lambda x: F.least(F.floor(x * n), F.lit(n - 1))
    cells = edges.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.when(F.col("open"), F.lit(n - 1)).otherwise(cell(F.col("hi"))))))
    point = F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI))
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", cell(F.col("point")))
    slots = points.join(cells, "cell").where("point >= lo and (open or point < hi)").select("slot", "pos", "blocks")
    slots = slots.withColumn("group", F.floor(F.col("slot") / 4096))
    counts = slots.groupBy("pos", "group").count()
    before = Window.partitionBy("pos").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("pos", "group").orderBy("slot")
    ranked = slots.withColumn("in", F.row_number().over(inside) - 1).join(counts, ["pos", "group"]).withColumn("rank", F.col("in") + F.col("base"))
    return ranked.where(F.col("rank") < MOST_REPEATS * F.col("blocks")).select("slot", "pos", "blocks", "rank")


def mix(docs: DataFrame, also: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and ``also``) for every document."""
    base, table, block = plan(docs)
    uses = schedule(table, block).groupBy("pos", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    table = common.small(table)
    known = base.join(table, base["source"].eqNullSafe(table["source"])).select("doc_id", base["source"], "size", "source_size", "target", "pos")
    shuffled = known.where("size > 0").withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    placed = common.running_total(shuffled.drop(*({"source"} - set(also))), ["pos", "key", "size"], "size", "before", "mix-order", extra=["doc_id"])
    # A source's stream begins where those of the sources before it end.
    starts = table.where("pos is not null").select("pos", own_block(block).alias("own"), (F.sum("source_size").over(Window.orderBy("pos")) - F.col("source_size")).alias("start"))
    placed = placed.join(common.small(starts), "pos").withColumn("from", F.col("before") - F.col("start")).withColumn("to", F.col("from") + F.col("size"))
    own = F.col("own")
    cut = placed.select("pos", "from", "to", "own", F.explode(F.sequence(F.floor(F.col("from") / own), F.floor((F.col("to") - 1) / own))).alias("block"))
    share = F.least(F.col("to"), (F.col("block") + 1) * own) - F.greatest(F.col("from"), F.col("block") * own)
    taken = cut.join(uses, ["pos", "block"]).groupBy("pos", "from").agg(F.sum(share * F.col("times")).alias("taken"))
    out = placed.join(taken, ["pos", "from"], "left").select("doc_id", *also, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = known.where("size = 0").select("doc_id", *also, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(empty)


def sampled(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it (``taken`` over size, rounded; texts without tokens never).

    Counts go to the documents by id, source and size; rows that share all three share their counts evenly.
    Counts are broadcast where there are few, else joined."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("of"), F.col("source").alias("from"), tokens(F.col("text")).alias("words"))
    got = mix(docs.select("doc_id", "text", "source"), ["source"]).where("taken > 0")
    counts = got.groupBy("doc_id", "source", "size").agg(F.round(F.sum("taken") / F.count(F.lit(1)) / F.first("size")).cast("int").alias("times")).where("times > 0")
    counts = common.small(common.materialize(counts, "mix-counts"))
    on = packed["of"].eqNullSafe(counts["doc_id"]) & packed["from"].eqNullSafe(counts["source"]) & (packed["words"] == counts["size"])
    return packed.join(counts, on).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all documents; see the module for the rules."""
    common.prepare(spark)
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = rf"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM sizes),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(pos - 1) % {len(WEIGHTS)} + 1] AS w, {MOST_REPEATS} * source_size AS cap FROM ranked WHERE source_size > 0),
r AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM w),
p AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lft
  FROM r WINDOW b AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, rest / lft > ratio AS stopped FROM p),
l AS (SELECT min_by(rest / lft, (ratio, pos)) AS level FROM s WHERE NOT stopped),
t AS (SELECT source, source_size, pos, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM s, l),
n AS (SELECT sum(source_size) AS total, greatest(1, least({BLOCK}, sum(source_size) // {SLOTS})) AS block FROM sizes),
g AS (SELECT t.*, block, total, CAST(greatest(1, least(block, source_size // {LEAST_BLOCKS})) AS BIGINT) AS own FROM t, n),
h AS (SELECT *, CAST(ceil(source_size / own) AS BIGINT) AS blocks FROM g),
f AS (SELECT *, CASE WHEN own = block THEN target ELSE target / source_size * blocks * block END AS share FROM h),
e AS (SELECT *, sum(share) OVER (ORDER BY pos) / sum(share) OVER () AS hi, coalesce(sum(share) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(share) OVER () AS lo, max(pos) OVER () AS last FROM f),
m AS (SELECT CAST(ceil((any_value(total) + round(sum(share - target))) / any_value(block)) AS BIGINT) AS many FROM f),
slots AS (SELECT i, i * CAST({PHI} AS DOUBLE) - floor(i * CAST({PHI} AS DOUBLE)) AS u FROM m, range(many) x(i)),
ranks AS (SELECT pos, blocks, row_number() OVER (PARTITION BY pos ORDER BY i) - 1 AS rank FROM slots JOIN e ON u >= lo AND (u < hi OR pos = last)),
uses AS (SELECT pos, rank % blocks AS blk, count(*) AS times FROM ranks WHERE rank < {MOST_REPEATS} * blocks GROUP BY ALL),
d AS (SELECT doc_id, size, e.source_size, target, pos, own, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM base JOIN e ON base.source IS NOT DISTINCT FROM e.source WHERE size > 0),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY pos ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
c AS (SELECT o.*, unnest(range(CAST(a // own AS BIGINT), CAST((a + size - 1) // own AS BIGINT) + 1)) AS blk FROM o),
k AS (SELECT c.pos, a, sum((least(a + size, (c.blk + 1) * own) - greatest(a, c.blk * own)) * times) AS taken FROM c JOIN uses ON uses.pos = c.pos AND uses.blk = c.blk GROUP BY ALL)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN k ON o.pos = k.pos AND o.a = k.a
UNION ALL SELECT doc_id, 0, sizes.source_size, coalesce(target, 0), 0 FROM base JOIN sizes ON base.source IS NOT DISTINCT FROM sizes.source LEFT JOIN t ON t.source IS NOT DISTINCT FROM sizes.source WHERE size = 0
"""
