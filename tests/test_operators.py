"""Operators against small brute-force versions."""

import itertools
import pathlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import embed
from millrace.operators import budget, cache, chunking, dedup, dense, graph, merge, rank
from millrace.plans import registry, search
from millrace.session import Settings


def test_budget_is_fair(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(1, 60)) for k in range(40) for i in range(rng.randrange(1, 9))]
    total = 100
    got = {(r.k, r.i): r.share for r in budget.shares(spark.createDataFrame(rows, "k int, i int, n int"), "k", "n", "i", total).collect()}
    for k, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        want, left = {i: 0 for _, i, _ in group}, total
        while left and any(want[i] < n for _, i, n in group):  # one character at a time, shortest saturate first
            for _, i, n in group:
                if left and want[i] < n:
                    want[i] += 1
                    left -= 1
        assert {i: got[k, i] for _, i, _ in group} == want


def test_merged_ranges(spark):
    rng = random.Random(5)
    rows = [(k, a, a + rng.randrange(1, 6), p) for k in range(30) for p in range(6) for a in [rng.randrange(30)]]
    got = {(r.k, r.start, r.end, r.priority) for r in chunking.merged(spark.createDataFrame(rows, "k int, start int, end int, priority int"), "k").collect()}
    want = set()
    for k in range(30):
        out = []
        for _, a, b, p in sorted(r for r in rows if r[0] == k):
            if out and a <= out[-1][1]:
                out[-1] = [out[-1][0], max(out[-1][1], b), min(out[-1][2], p)]
            else:
                out.append([a, b, p])
        want |= {(k, *x) for x in out}
    assert got == want


def test_passages_mark_what_is_left_out(spark):
    doc = "alpha beta gamma delta epsilon zeta eta theta"
    ranges = spark.createDataFrame([(1, 0, 10, 1), (1, 17, 22, 0), (1, 5, 10, 2)], "doc_id int, start int, end int, priority int")
    r = chunking.assembled(ranges, spark.createDataFrame([(1, doc)], "doc_id int, text string")).first()
    assert r.truncated and r.passage == "delta\n\n…\n\nalpha beta\n\n…"


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (10, 3)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 9: 9} | {100 + i: 100 for i in range(21)}


def test_near_pairs_find_all(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(10_000)}" for _ in range(120)] for _ in range(6)]
    docs = []
    for b in base:
        for k in range(5):
            words = list(b)
            for j in rng.sample(range(120), k // 2):
                words[j] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(words), f"s{len(docs) % 2}"))
    docs += [(100 + i, " ".join(base[0][:60] + [f"y{i}{j}" for j in range(60)]), "s0") for i in range(4)]
    got = {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(docs, "doc_id long, text string, site string")).collect()}
    sets = {}
    for i, t, s in docs:
        w = t.replace(".", " ").split()
        sets[i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)}, s)
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        (x, s), (y, t) = sets[a], sets[b]
        low, high, both = min(len(x), len(y)), max(len(x), len(y)), len(x & y)
        if s == t and both * 100 >= low * 95 and both * 100 >= high * 82 or both * 100 >= low * 98 and both * 100 >= high * 95:
            want.add((a, b))
    assert got == want and want


def test_near_pairs_send_first_shingles_only(spark):
    """A fifth of every set, frequent shingles last; pairs of copies come from their firsts."""
    hot = " ".join(f"h{i}" for i in range(60))
    texts = [f"{hot} " + " ".join(f"w{k}x{i}" for i in range(60)) for k in range(40)]
    docs = spark.createDataFrame([(3 * k + c, t, None if k % 2 else "s") for k, t in enumerate(texts) for c in range(3)], "doc_id long, text string, site string")
    sets = docs.select("doc_id", "site", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("s")).withColumn("n", F.size("s"))
    got = dedup.heads(sets, 95, 82).collect()
    common = {r.h for r in spark.createDataFrame([(w,) for w in hot.split()], "w string").select(F.xxhash64("w").alias("h")).collect()}
    assert len(got) == 120 * (120 - 99 + 1) and sum(r.strict for r in got) == 120 * (120 - 114 + 1) and not common & {r.h for r in got}
    assert {(r.a, r.b, r.shared) for r in dedup.near_pairs(docs).collect()} == {(3 * k + a, 3 * k + b, 116) for k in range(40) for a, b in ((0, 1), (0, 2), (1, 2))}


def test_near_links_store_no_sets(spark):
    """Documents that no other is near leave a row for their size, and their texts stay in their partitions."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(16**6):06x}" for _ in range(3000)) for _ in range(96)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, texts[7]])], "doc_id long, text string, site string").repartition(8).cache()
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    assert [tuple(r) for r in dedup.near_links(docs).collect()] == [(7, 96)]
    assert size() - before < 96 * 2996 * 8 / 10
    once, members = dedup.firsts_of(docs, ["site"])
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in members.collect()} == {(7, 7), (7, 96)} and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and dedup.spread(once) is once


@pytest.mark.parametrize("name", ["a11_representatives", "j3_near_pairs"])
def test_near_duplicates_store_less_than_the_texts(spark, name):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before, data = size(), "/root/testdata/sf0.01"
    assert registry.queries()[name](spark, data).count()
    assert size() - before < spark.read.parquet(f"{data}/documents.parquet").select(F.sum(F.octet_length("text"))).first()[0] / 2


def test_sets_go_to_few_blocks(spark):
    """Documents that all meet each other: every pair's key is one of both documents', and a document has few keys, not one for each pair."""
    pairs = spark.createDataFrame(list(itertools.combinations(range(300), 2)), "a long, b long")
    keyed, to = dedup.blocks(pairs)
    keys = {r.doc_id: set(r["keys"]) for r in to.collect()}
    rows = keyed.collect()
    assert {(r.a, r.b) for r in rows} == set(itertools.combinations(range(300), 2)) and all(r.key in keys[r.a] & keys[r.b] for r in rows)
    assert len(keys) == 300 and max(map(len, keys.values())) <= 5


def test_parities_leave_out_no_pair():
    rng = np.random.default_rng(2)
    sets, out = [], 0
    for n in (40, 63, 64, 65, 120, 500, 1024, 1100):
        base = rng.integers(-(1 << 63), 1 << 63, n)
        sets += [base, rng.integers(-(1 << 63), 1 << 63, n), base[n // 20 :], np.concatenate([base, rng.integers(-(1 << 63), 1 << 63, n // 6)])]
    size = np.array([len(s) for s in sets])
    bits = dedup.parities(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size).to_pylist()
    for i, j in itertools.combinations(range(len(sets)), 2):
        near = len(np.intersect1d(sets[i], sets[j])) * 100 >= 82 * max(size[i], size[j])
        may = dedup.may_share((int(size[i]), bits[i]), (int(size[j]), bits[j]), 82)
        assert may or not near
        out += not may
    assert out > 400


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, pos int, url string")


def test_merges(spark):
    a, b = ranked(spark, [(1, i, f"a{i}") for i in range(3)]), ranked(spark, [(1, 0, "b0"), (1, 1, "a1")])
    urls = lambda df: [r.url for r in df.orderBy("query_id", "pos").collect()]
    assert urls(merge.interleave(a, b)) == ["a0", "b0", "a1", "a1", "a2"]
    assert urls(merge.backfill(a, b, 4)) == ["a0", "a1", "a2", "b0"]
    assert urls(merge.local_merge(a, b, 1)) == ["b0", "a0", "a1", "a2", "a1"]
    assert urls(merge.prioritize(a, F.col("url") == "a2")) == ["a2", "a0", "a1"]
    empty = ranked(spark, []).limit(0)
    assert urls(merge.interleave(empty, b)) == ["b0", "a1"] and urls(merge.interleave(a, empty)) == ["a0", "a1", "a2"]


def test_entities_follow_order(spark):
    rows = [
        (1, 0, "u0", "A title of four words", None, "", None, ["k0"], "a title of four words", False),
        (1, 1, "u1", "Other", "2024-01-01", "s", "10.1/x", ["k1"], "other", False),
        (1, 2, "u2", "A title of four", None, "found", "10.1/y", ["k2"], "a title of four", True),
        (1, 3, "u3", "Third", "2025-01-01", "t", "10.1/x", ["k3"], "third", False),
        (1, 4, "u4", "Fourth", None, "", None, ["k9", "k2"], "fourth", False),
    ]
    df = spark.createDataFrame(rows, "query_id long, pos int, url string, title string, date string, snippet string, doi string, url_keys array<string>, title_key string, source_priority boolean")
    got = {r.url: r for r in dedup.entities(df).collect()}
    assert set(got) == {"u0", "u1"}
    assert got["u0"].snippet == "found" and got["u0"].source_priority and set(got["u0"].urls) == {"k0", "k2", "k9"}
    assert got["u1"].date == "2025-01-01"


def test_shortlist(spark):
    rows = [(1, i, s, p, c) for i, (s, p, c) in enumerate([(0.50, False, True), (0.90, False, False), (0.20, True, False), (0.85, False, True), (0.95, False, False), (0.10, True, False)])]
    df = spark.createDataFrame(rows, "query_id int, pos int, score double, source_priority boolean, upstream_consensus boolean")
    got = [r.pos for r in rank.shortlist(df, 4).orderBy("selected").collect()]
    assert got == [2, 4, 1, 3]


def test_pacing_and_cache(spark):
    times = [("a", float(t)) for t in (0, 1, 2, 30, 31)]
    df = spark.createDataFrame(times, "key string, at double")
    assert [r.started for r in cache.paced(df, "key", "at", 10).orderBy("requested").collect()] == [0, 10, 20, 30, 40]
    assert [r.hit for r in cache.served(df, "key", "at", 2).orderBy("at").collect()] == [False, True, False, False, True]


def test_packing():
    assert embed.packed([3, 3, 4, 9, 1], 12, 5) == [[0, 1, 2], [3], [4]]
    with pytest.raises(ValueError):
        embed.packed([13], 12)


def test_settings():
    assert Settings.from_env({"MILLRACE_SEARCH_PERMITS": " 5 ", "MILLRACE_CATEGORIES": " "}) == Settings(search_permits=5)
    with pytest.raises(ValueError):
        Settings.from_env({"MILLRACE_SEARCH_PERMITS": "x"})


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 300), (2, "beta delta"), (3, ""), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "gamma delta"), (2, " "), (3, "absent")], "query_id int, query string")
    rows = search.search(queries, docs, 2, 200).collect()
    assert {(r.query_id, r.doc_id) for r in rows} == {(1, 1), (1, 2)}
    assert sum(len(r.content) for r in rows) <= 200 and any(r.truncated for r in rows)
    with pytest.raises(ValueError):
        search.search(queries, docs, 11)


def test_nearest_vectors_of_all_queries(spark, monkeypatch):
    """More queries than a block holds, ties after rounding, copies, rows without a vector."""
    monkeypatch.setattr(dense, "QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = {i: [float(x) for x in rng.integers(-2, 3, 4) / 2 + rng.integers(0, 3, 4) * 1e-8] for i in range(300)}
    rows = spark.createDataFrame([*vectors.items(), (301, None)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in dense.nearest(rows.where("vec_id % 10 = 0"), rows, 3).collect():
        got.setdefault(r.query_id, {})[r.place] = r.vec_id
    single = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items()}
    for q in range(0, 300, 10):
        best = sorted((-round(float(single[q] @ single[i]), 6), i) for i in vectors if i != q)[:3]
        assert got.pop(q) == {place: i for place, (_, i) in enumerate(best, 1)}
    assert not got and dense.nearest(rows.limit(0), rows, 3).count() == 0


def test_chunks_are_sent_on_in_small_batches():
    docs = [(i, "word " * n) for i, n in enumerate([0, 3, 400_000, *[2000] * 500, 1])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    got = list(chunking.windows(iter([batch]), 512, 64, chunking.spans))
    assert max(sum(map(len, b["text"].to_pylist())) for b in got) < chunking.HELD + 4096
    want = [(i, k, t[a:b]) for i, t in docs for k, (a, b, _) in enumerate(chunking.spans(t, 512, 64))]
    assert [x for b in got for x in zip(*(b[c].to_pylist() for c in ("doc_id", "ordinal", "text")), strict=True)] == want


def test_nearest_vectors_in_bounded_memory():
    """A whole batch of copies against a whole block of queries."""
    rng = np.random.default_rng(3)
    n, vectors = 10_000, rng.normal(size=(8, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(vectors[np.arange(n) % 8]))], ["vec_id", "embedding"])
    tracemalloc.start()
    got = pa.Table.from_batches(dense.tops(iter([batch] * 2), np.arange(4096) + n, rng.normal(size=(4096, 16)), 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3 * 4096 and peak < 256 << 20


def test_dense_search_has_every_fiftieth_row_as_query(spark, tmp_path):
    e = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(1000)], "vec_id long, embedding array<float>")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["v1_dense_search"](spark, str(tmp_path))
    assert {r.query_id for r in got.collect()} == set(range(0, 1000, 50)) and got.count() == 200


def test_official_hosts(spark):
    cases = [
        ("SQLite WAL mode concurrent readers writers", [("https://coddy.tech/docs/sqlite/wal-mode", "SQLite WAL mode and concurrency"), ("https://sqlite.org/index.html", "SQLite Home Page"), ("https://sqlite.org/wal.html", "Write-Ahead Logging")], ("sqlite.org", 5)),
        ("Qwen3 Coder model context length", [("https://qwen3.app/", "Qwen3 model guide"), ("https://qwen.ai/blog?id=qwen3-coder", "Qwen3-Coder: Agentic Coding in the World")], ("qwen.ai", 6)),
        ("California 2026 election voter registration deadline", [("https://industry.visitcalifornia.com/meeting", "California 2026 registration"), ("https://www.sos.ca.gov/elections", "California 2026 General Election")], ("ca.gov", 4)),
        ("serde derive", [("https://github.com/serde", "serde derive"), ("https://docs.rs/serde/1.0", "Serde")], ("docs.rs", 4)),
        ("tokio runtime", [("https://blog.example.com/tokio", "tokio runtime")], None),
        ("tokio runtime", [("https://other.org/", "x")] * 12 + [("https://tokio.rs/", "Tokio runtime")], None),
    ]
    queries = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(cases)], "query_id int, query string")
    results = spark.createDataFrame([(i, k, u, t, []) for i, (_, r, _) in enumerate(cases) for k, (u, t) in enumerate(r)], "query_id int, pos int, url string, title string, engines array<string>")
    got = {r.query_id: (r.host, r.score) for r in rank.infer_official_host(queries, results).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases) if want}
    engines = results.where("query_id = 0").withColumn("engines", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    assert rank.infer_official_host(queries, engines).first().score == 7
