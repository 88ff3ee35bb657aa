"""Fill-in-the-middle, vector links and clusters: against versions that go step by step."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import centroids, middle, vecdup
from tests.rows import rows

# ---- fill in the middle

TEXTS = ["", None, "a", "abc", "日本語テキスト", "é" * 700, "x<P>y", "x<P y", "<S", "<<M>", "𝄞𝄞a𝄞" * 90, "<" * 600, "<P" * 300, "<M" * 200 + ">", "plain words " * 400, "naïve café 𝄞 <b>bold</b> <p>" * 60, ">P<", "<S>"]


def by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("lane", [1, 2, 7, 256])
def test_scan(monkeypatch, lane):
    monkeypatch.setattr(middle, "LANE", lane)
    monkeypatch.setattr(middle, "LANES", 64)
    texts = [t or "" for t in TEXTS]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    scan = middle.Scan(data, bounds)
    assert scan.units.tolist() == [len(t) for t in texts]
    assert scan.sentinels.tolist() == [sum(t.count(s) for s in ("<P>", "<S>", "<M>")) for t in texts]
    rng = random.Random(lane)
    at = [(i, rng.randint(0, len(t))) for i, t in enumerate(texts) for _ in range(9)]
    got = scan.cuts(np.array([i for i, _ in at]), np.array([u for _, u in at]))
    assert got.tolist() == [bounds[i] + len(texts[i][:u].encode()) for i, u in at]


def test_bytes_that_are_no_text():
    data = np.frombuffer(b"\x80\x80a\xc3(\xf0\x9f<P>\xbf", np.uint8)
    scan = middle.Scan(data, np.array([0, len(data)]))
    assert scan.units.tolist() == [7] and scan.sentinels.tolist() == [1]


def test_middle(spark):
    given = [(i, TEXTS[i % len(TEXTS)]) for i in range(200)] + [(None, "no id here"), (7, TEXTS[7]), (7, TEXTS[7])]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1)).repartition(3)
    out = middle.transformed(df)
    got = out.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted((i is None, i or 0, *by_hand(i, t)) for i, t in given)
    want = {(i, by_hand(i, t)[4]): t or "" for i, t in given}
    assert all(r.back == want[r.doc_id, r.output] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.transformed(df.limit(0)).count() == 0


# ---- links of vectors


def linked(vectors):
    """By comparing all: (links, smallest id of the component) of each row."""
    fit = [e is not None and lab is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e, lab in vectors]
    n = len(vectors)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]):
                x, y = (np.float32(vectors[k][1]).astype(np.float64) for k in (i, j))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= vecdup.NEAR:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((vectors[j][0] for j in seen if vectors[j][0] is not None), default=None)
        out.append((vectors[i][0], len(links[i]), least, vectors[i][0] is not None and vectors[i][0] == least))
    return out


def some_vectors(n=300, d=16, seed=0):
    rng = np.random.default_rng(seed)
    out = [(i, rng.standard_normal(d).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    for i in range(0, n, 3):  # near ones, chains of them, exact copies
        base = np.array(out[i][1])
        out.append((1000 + i, (base + 0.2 * rng.standard_normal(d)).astype(np.float32).tolist(), out[i][2]))
        out.append((2000 + i, (base + 0.4 * rng.standard_normal(d)).astype(np.float32).tolist(), out[i][2]))
        out.append((3000 + i, out[i][1], out[i][2]))
    dense = rng.standard_normal(d)
    out += [(5000 + i, (dense + 0.15 * rng.standard_normal(d)).astype(np.float32).tolist(), 1) for i in range(150)]
    out += [(6000 + i, [3.0 * x for x in out[0][1]], out[0][2]) for i in range(40)]
    return out


ODD = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [], 1), (9005, [1.0] * 16, None), (9006, [1.0] * 8, 1), (9007, [1.0] * 8, 1), (9008, [3e38] * 8, 1), (9009, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 4, 2), (None, [1.0] * 4, 2), (9010, [1.0] * 4, 2), (None, [5.0, 1.0], 2), (9011, [1.0] * 5, 7)]


@pytest.mark.parametrize("shard", [1 << 17, 100, 3])
def test_links(spark, shard):
    given = some_vectors() + ODD + [(9010, [1.0] * 4, 2)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("copies", F.lit("y")).withColumn("dims", F.lit(0)).repartition(5)
    got = [tuple(r) for r in vecdup.links(df, shard).collect()]
    assert sorted(got, key=repr) == sorted(linked(given), key=repr)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vecdup.links(df).count() == 0
    alone = spark.createDataFrame([(1, None, None), (2, [1.0], 1)], df.schema)
    assert sorted(map(tuple, vecdup.links(alone).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_graph_finds_what_comparing_all_finds(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[2000:] = x[:1000] + 0.15 * rng.standard_normal((1000, 64)).astype(np.float32)
    x[:300] = x[0] + 0.1 * rng.standard_normal((300, 64)).astype(np.float32)
    compared = []
    whole = vecdup.Shard.compared
    monkeypatch.setattr(vecdup.Shard, "compared", lambda self, q: compared.append(len(q)) or whole(self, q))
    s = vecdup.Shard(np.arange(3000), np.ones(3000, np.int64), x)
    assert s.width and sum(compared) <= 2 * vecdup.AUDIT  # the audit only: its truth, and probes in the dense group
    s.inside()
    assert sum(compared) <= 2 * vecdup.AUDIT + 700  # and the dense group's rows
    u = x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = (u @ u.T >= vecdup.NEAR).sum(1) - 1
    assert s.links.sum() >= 0.99 * want.sum() > 0 and (s.links <= want[s.nodes]).all()


def test_failed_audits_compare_in_full(monkeypatch):
    monkeypatch.setattr(vecdup.Graph, "beam", lambda self, to, q, entries, width: (np.full((len(q), width), -1, np.int32), np.full((len(q), width), vecdup.MINUS)))
    given = some_vectors(60)
    s = vecdup.Shard(np.arange(len(given)), np.ones(len(given), np.int64), np.float32([v[1] for v in given]))
    assert s.width == 0
    s.inside()
    want = {i: r[1] for i, r in enumerate(linked([(*v[:2], 0) for v in given]))}
    assert dict(zip(s.nodes.tolist(), s.links.tolist(), strict=True)) == want


# ---- clusters


def clusters(vectors, k=16, rounds=3):
    """Step by step, in Python's integers."""
    key = lambda v: (hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1])
    fit = sorted((v for v in vectors if v[1] is not None and len(v[1]) == 64 and all(x is not None and math.isfinite(x) for x in v[1])), key=key)
    x = [[math.floor(64 * float(np.float32(c))) for c in v[1]] for v in fit]
    means = x[:k]
    near = lambda row: min((sum((a - b) ** 2 for a, b in zip(row, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        at = [near(row)[1] for row in x]
        means = [[sum(col) // len(col) for col in zip(*[row for row, c in zip(x, at, strict=True) if c == m], strict=True)] or means[m] for m in range(len(means))]
    last = [near(row) for row in x]
    per = {c: sum(d for d, e in last if e == c) for _, c in last}
    return [(v[0], c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for v, (d, c) in zip(fit, last, strict=True)]


@pytest.mark.parametrize("n", [400, 9, 0])
def test_lloyd(spark, n):
    rng = np.random.default_rng(n)
    given = [(i, (rng.standard_normal(64) * (1 + i % 3)).astype(np.float32).tolist(), 1) for i in range(n)]
    given += [given[i] for i in range(0, n, 7)] + [(None, given[0][1], 1)] * 2 if n else []
    given += [(9000, None, 1), (9001, [1.0] * 63, 1), (9002, [float("nan")] * 64, 1), (9003, [1.0] * 63 + [None], 1), (9004, [float("inf")] * 64, 1)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, cluster int").withColumn("distance", F.lit("x")).repartition(3)
    got = [tuple(r) for r in centroids.lloyd(df).drop("centroid").collect()]
    assert sorted(got, key=repr) == sorted(clusters(given), key=repr)
    con = duckdb.connect()
    arrow = df.select("vec_id", "embedding").toArrow()
    con.register("embeddings", arrow)
    want = con.sql(centroids.OP13_SQL)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows(names, got) == rows(want.columns, want.fetchall())


def test_lloyd_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [3e38] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        centroids.lloyd(df).collect()


def test_sql_of_links(spark):
    """The SQL on rows that have links (those of the smallest tables have none)."""
    given = some_vectors(60) + ODD
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.sql(vecdup.OP12_SQL)
    assert rows(want.columns, want.fetchall()) == rows(["vec_id", "n_links", "component_id", "kept"], linked(given))
