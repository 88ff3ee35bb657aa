"""Indexes, ordered matching, token windows, learned vectors: against versions that look at everything."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import learned, subwords, text
from millrace.operators import chunking, dedup, dense, evidence, matching, postings, vectorindex
from millrace.plans import indexed

# ---- inverted index


def some_docs(n=900, seed=3):
    rng = random.Random(seed)
    rare = [f"rare{i}" for i in range(60)]
    return [(i * 37 - 500, " ".join(["common"] * (i % 3 > 0) + ["often"] * (i % 2) + [rng.choice(rare) for _ in range(2)] + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 20))])) for i in range(n)]


def by_scan(spark, docs, queries, k):
    terms = evidence.query_terms(queries)
    hits = evidence.matches(docs, terms)
    scores = evidence.coverage(evidence.weights(terms, hits, docs.count()), hits).withColumn("score", F.round("score", 9)).collect()
    out = []
    for q in {r.query_id for r in scores}:
        best = sorted((-r.score, r.doc_id) for r in scores if r.query_id == q)[:k]
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(best)]
    return sorted(out)


def test_top_lists_from_postings(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame(some_docs(), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "rare1 rare2 common often"), (2, "common often"), (3, "rare5 w3 w4 w5 common"), (4, "nothing known"), (5, "rare7"), (6, "w1 absent common often rare9 rare9")], "query_id int, query string")
    monkeypatch.setattr(postings, "SPAN", 512)
    index = postings.build(docs, f"file://{tmp_path}/index")
    blocks = index.blocks(spark)
    assert blocks.agg(F.max("n")).first()[0] <= 512 and blocks.where("term = 'common'").count() > 10  # a hot term is many blocks
    read = []
    got = sorted((r.query_id, r.doc_id, r.score, r.place) for r in postings.top(index, asked, 10, read).collect())
    assert got == by_scan(spark, docs, asked, 10)
    # Terms that are in most documents are read where there are candidates only.
    read = []
    one = spark.createDataFrame([(1, "rare1 rare2 common often")], asked.schema)
    assert sorted((r.query_id, r.doc_id, r.score, r.place) for r in postings.top(index, one, 10, read).collect()) == by_scan(spark, docs, one, 10)
    whole = index.terms(spark).where("term in ('rare1', 'rare2', 'common', 'often')").agg(F.sum("df")).first()[0]
    assert read[-1] < whole
    near = spark.createDataFrame([(i, "rare1 rare2" if i < 12 else "common often" if i % 2 else "common") for i in range(4000)], "doc_id long, text string")
    index, read = postings.build(near), []
    assert sorted((r.query_id, r.doc_id, r.score, r.place) for r in postings.top(index, one, 10, read).collect()) == by_scan(spark, near, one, 10)
    assert sum(read) < 0.2 * 6000


def test_no_postings(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a word"), (2, None)], "query_id int, query string")
    assert postings.top(postings.build(none), asked, 5).count() == 0
    some = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (None, "word")], "doc_id long, text string")
    assert [(r.query_id, r.doc_id) for r in postings.top(postings.build(some), asked, 5).collect()] == [(1, 3)]


# ---- inverted lists


def recall(spark, got, truth):
    pair = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want = pair(truth)
    return len(pair(got) & want) / len(want)


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_inverted_lists(spark, clustered):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32))
    if clustered:
        x = rng.standard_normal((60, 32))[rng.integers(0, 60, 3000)] * 2 + 0.4 * x
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (9999, None)], "vec_id long, embedding array<float>").repartition(4)
    queries = rows.where("vec_id % 50 = 0")
    index = vectorindex.tuned(vectorindex.build(rows), queries, rows, 10)
    got = vectorindex.search(index, queries, rows, 10)
    truth = dense.nearest(queries, rows, 10)
    assert recall(spark, got, truth) >= 0.9
    exact = {(r.query_id, r.vec_id): r.score for r in truth.collect()}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got.collect() if (r.query_id, r.vec_id) in exact)
    stored = spark.read.parquet(index.path)
    assert stored.count() == 3000 and stored.select("vec_id").distinct().count() == 3000  # every row is in one list
    if clustered:  # few lists are needed there
        assert index.probes <= 0.5 * len(index.books.centroids)


def test_all_lists_and_candidates_are_the_exact_search(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(200)], "vec_id long, embedding array<float>")
    index = vectorindex.build(rows, lists=7)
    whole = vectorindex.Index(index.path, index.books, 7, 200)
    key = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "score", "place").collect()))
    assert key(vectorindex.search(whole, rows, rows, 5)) == key(dense.nearest(rows, rows, 5))
    assert vectorindex.search(vectorindex.build(rows.limit(0)), rows, rows, 5).count() == 0


# ---- ordered matching


def results(seed, n=120, queries=2):
    rng = random.Random(seed)
    out = []
    for q in range(queries):
        for pos in range(n):
            words = [f"w{rng.randrange(3)}" for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 9]))]
            title = rng.choice([" ".join(words), "untitled", f"a b c d {rng.randrange(4)} e f", "a b c d", "a b c d 1", ""])
            keys = [f"k{rng.randrange(90)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]
            out.append((q, pos, f"u{pos}", title, rng.choice([None, "2024-01-0" + str(rng.randrange(1, 9))]), rng.choice(["", None, f"s{pos}"]), rng.choice([None, "", f"d{rng.randrange(60)}"]), keys, title, rng.random() < 0.2))
    return out


SCHEMA = "query_id long, pos int, url string, title string, date string, snippet string, doi string, url_keys array<string>, title_key string, source_priority boolean"


@pytest.mark.parametrize("seed", range(4))
def test_matching_is_the_sequential_fold(spark, seed):
    df = spark.createDataFrame(results(seed), SCHEMA).repartition(5)
    fold = sorted((r.query_id, r.url, r.title or None, r.date, r.snippet, r.source_priority, len(set(r.urls))) for r in dedup.entities(df, limit=10**6).collect())
    got = sorted((r.query_id, r.url, r.title or None, r.date, r.snippet, r.source_priority, r["keys"]) for r in matching.things(df).collect())
    assert got == fold
    assert matching.things(df).agg(F.sum("rows")).first()[0] == df.count()


def test_matching_of_nothing(spark):
    assert matching.things(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matching_of_one_long_chain(spark):
    """Titles that each begin with the one before: every third word more, in an order that settles one a round."""
    titles = [" ".join(f"w{i}" for i in range(n)) for n in range(4, 40)]
    rows = [(1, i, f"u{i}", t, None, "", None, [f"k{i}"], t, False) for i, t in enumerate(reversed(titles))]
    df = spark.createDataFrame(rows, SCHEMA)
    fold = sorted(r.url for r in dedup.entities(df, limit=10**6).collect())
    assert sorted(r.url for r in matching.things(df).collect()) == fold


# ---- token windows

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(doc):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(doc, add_special_tokens=False).offsets


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_offsets_in_pieces(size):
    docs = ["", "one", "日本語 テキスト 𝄞𝄞 naïve  café\n\n x", "don't  stop , it's 3.14 (really) " * 20, " lead", "trail ", "a" * 3000, "  two  spaces  "]
    for doc in docs:
        assert subwords.offsets(PATH, doc, size) == whole(doc)


def test_windows_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in chunking.chunks(docs, 100, 20, subwords.windows(PATH)).collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.start, r.end, r.tokens, r.text))
    for doc_id, doc in docs.select("doc_id", "text").collect():
        at, want = whole(doc), []
        for i, k in enumerate(range(0, len(at), 80)):
            part = at[k : k + 100]
            want.append((i, part[0][0], part[-1][1], len(part), doc[part[0][0] : part[-1][1]]))
            if k + 100 >= len(at):
                break
        assert sorted(got.get(doc_id, [])) == want


# ---- learned vectors


def test_singular_values_of_a_dense_solver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "!!")], "doc_id long, text string"))
    model = learned.fit(docs, "doc_id", "text", dims=12, n=512, rounds=12)
    rows = sorted(learned.features(docs, "doc_id", "text", 512).collect(), key=lambda r: r.key)
    count = np.zeros((len(rows), 512))
    for i, r in enumerate(rows):
        np.add.at(count[i], r.terms, 1)
    x = np.log1p(count) * (np.log((len(rows) + 1) / ((count > 0).sum(0) + 1)) + 1)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    u, s, v = np.linalg.svd(x)
    assert np.allclose(model.values, s[:12], rtol=2e-3)
    got = {r.doc_id: r for r in learned.embed(docs, "doc_id", "text", model).collect()}
    assert len(got) == len(rows) and got[-1].share == 0 and not any(got[-1].embedding)
    share = np.array([got[r.key].share for r in rows])
    assert np.allclose(share.sum(), (s[:12] ** 2).sum(), rtol=2e-3) and share.max() <= 1 + 1e-9
    left = np.stack([got[r.key].embedding for r in rows if got[r.key].share])
    assert np.allclose(np.linalg.norm(left, axis=1), 1, atol=1e-5)
    assert text is not None


def test_terms_of_learned_vectors_are_made_once(spark, monkeypatch):
    made, features = [], learned.features
    monkeypatch.setattr(learned, "features", lambda *a: made.append(a) or features(*a))
    got = indexed.v3_learned_vectors(spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = learned.embed(docs, "doc_id", "text", learned.fit(docs, "doc_id", "text")).collect()
    assert {r.doc_id: r.share for r in got} == {r.doc_id: pytest.approx(r.share, abs=6e-4) for r in want}


def test_gram_matrix_of_texts_with_and_without_terms(spark, monkeypatch):
    monkeypatch.setattr(learned, "TERMS", 3)  # several slices of a batch
    terms = [[], [5, 1, 5], [0, 299, 7, 7, 7], [1], [], [299] * 9, []]
    rows = learned.counted(spark.createDataFrame(list(enumerate(terms)), "key long, terms array<int>").coalesce(1))
    got = {r.key: (r.features, r.counts) for r in rows.collect()}
    assert got == {k: (sorted(set(t)), [t.count(f) for f in sorted(set(t))]) for k, t in enumerate(terms)}
    assert learned.frequencies(rows, 300).tolist() == [sum(f in t for t in terms) for f in range(300)]
    rarity, right = np.linspace(1, 2, 300), np.random.default_rng(1).standard_normal((300, 4))
    x = np.array([[np.log1p(t.count(f)) * rarity[f] for f in range(300)] for t in terms])
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    assert np.allclose(learned.gram_times(rows, rarity, right), x.T @ (x @ right))
