"""Trained models: gradients and marginals against brute force, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, langid, quality, tokens, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or".split(), "fr": "le de ou ai eau que tion en re é è ç".split(), "de": "sch ei ung ich ten ü ö ß ver be ge st".split()}


def sentence(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


# ---- Kneser-Ney


def kneser_ney(docs, n):
    """Interpolated modified model over bytes, directly from its definition."""
    levels = {n: Counter()}
    for d in docs:
        raw = b"\0" * (n - 1) + d.encode()
        for i in range(n - 1, len(raw)):
            levels[n][raw[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, table in levels.items():
        c = Counter(table.values())
        n1, n2, n3, n4 = (c[i] for i in (1, 2, 3, 4))
        if not n1 or not n2:
            cuts[k] = [0.5, 1.0, 1.5]
            continue
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        cuts[k] = [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        below = p(gram[1:])
        rest = {g: c for g, c in levels[k].items() if g[:-1] == gram[:-1]}
        if not rest:
            return below
        total, cut = sum(rest.values()), lambda c: cuts[k][min(c, 3) - 1]
        spare = sum(cut(c) for c in rest.values())
        c = rest.get(gram, 0)
        return (c - cut(c) if c else 0) / total + spare / total * below

    def perplexity(text):
        raw = b"\0" * (n - 1) + text.encode()
        logs = [math.log(p(raw[i - n + 1 : i + 1])) for i in range(n - 1, len(raw))]
        return math.exp(-sum(logs) / len(logs)) if logs else None

    return perplexity


@pytest.mark.parametrize("shard", [1 << 22, 100])
def test_perplexity(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD", shard)
    monkeypatch.setattr(quality, "PIECE", 64)
    rng = random.Random(3)
    docs = [sentence("fr", rng.randrange(1, 8), rng) for _ in range(12)]
    shards = quality.save(quality.build(spark.createDataFrame([(d,) for d in docs], "text string")))
    assert (len(shards.paths) > 1) == (shard == 100) and sum(shards.sizes) > 100
    want = kneser_ney(docs, quality.ORDER)
    texts = [docs[0], "ou zzz", "Ü", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r for r in quality.score(rows, shards).collect()}
    for i, t in enumerate(texts):
        expected = want(t) if t else None
        assert got[i].perplexity == (pytest.approx(expected, rel=1e-4) if expected else None)
    # However often texts back off, a batch reads a shard once, or twice where two levels meet in it.
    model = quality.Model(shards)
    for batch in (texts, [*docs, "zü zu zö " * 50], [""]):
        before = model.loads
        model.table(pa.array(batch))
        assert model.loads - before <= len(shards.paths) + 2 * quality.ORDER
    assert len(model.kept) <= quality.KEPT


def test_repeated_share():
    texts = ["", "a", "abcdefgh", "word " * 400, None, "x" * 600]
    _, keys, bounds = next(quality.grams(pa.array(texts)))
    want = []
    for t in texts:
        b = (t or "").encode()
        grams = [(k // quality.WINDOW, (b"\0" * 4 + b)[k : k + 5]) for k in range(len(b))]
        want.append(1 - len(set(grams)) / max(1, len(b)))
    assert quality.repeated(keys, bounds) == pytest.approx(want)


def test_quality_decisions(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(480):
        lang = "en" if i % 5 < 3 else "fr"
        junk = i % 6 == 0
        text = sentence(lang, rng.randrange(5, 60), rng)
        docs.append((i, "".join(rng.choice("&%$#*!") for _ in range(200)) if junk else text, lang if i % 9 else None, "x"))
        if i % 3 == 0:
            labels.append((i, 0 if junk else 1))
    docs += [(900, "", "en", "x"), (901, None, "en", "x"), (3, docs[3][1], docs[3][2], "x"), (None, docs[5][1], "en", "x"), (902, docs[5][1], "none known", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, perplexity string")
    lab = spark.createDataFrame([*labels, (3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality.judge(df, lab).collect()}
    good = {i for i in range(480) if i % 6}
    assert sum(got[i] for i in good) >= 0.97 * len(good)
    assert not any(got[i] for i in range(0, 480, 6)) and got[900] is got[901] is False and got[902]
    kept = quality.accepted(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality.judge(df.limit(0), lab).count() == 0
    assert {r.keep for r in quality.judge(df, lab.limit(0)).collect()} == {True, False}


# ---- recurrent network


def test_gradients():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, lengths, labels = rng.integers(0, 256, (5, 6)).astype(np.uint8), np.array([6, 3, 1, 5, 2]), np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(data, lengths, labels)
    for name, v in net.p.items():
        at = (data[0, 0], 2) if name[0] == "x" else tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-3
        up = net.gradients(data, lengths, labels)[0]
        v[at] -= 2e-3
        down = net.gradients(data, lengths, labels)[0]
        v[at] += 1e-3
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=1e-5)


def test_language_accuracy(spark):
    rng = random.Random(8)
    rows = [(i, sentence(lang, rng.randrange(3, 30), rng), lang) for i in range(360) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(1000, None, "en"), (1001, "123 ...", "en"), (1002, sentence("de", 20, rng), None), (None, sentence("fr", 20, rng), "fr"), (1003, "x" * 100_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify(df, langid.fit(df)).collect()
    true = {(r[0]): r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1000].score == 0
    assert by[1002].lang_pred == "de" and by[None].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0), None).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.where("lang is null"))).collect()} == {"und"}


def plain_states(net, raw, d):
    """States of one direction over a sequence of bytes, one step at a time."""
    x, u = net.p["x" + d].astype(float), net.p["u" + d].astype(float)
    hid, out = u.shape[0], []
    h = np.zeros(hid)
    s = lambda v: 1 / (1 + np.exp(-v))
    for byte in raw if d == "f" else raw[::-1]:
        g = h @ u
        z, r = s(x[byte, :hid] + g[:hid]), s(x[byte, hid : 2 * hid] + g[hid : 2 * hid])
        h = z * h + (1 - z) * np.tanh(x[byte, 2 * hid :] + r * g[2 * hid :])
        out.append(h)
    return out if d == "f" else out[::-1]


@pytest.mark.parametrize("piece", [50, 1 << 18])
def test_language_probabilities_against_single_steps(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    net = langid.Network(["a", "b", "c"], 5)
    texts = ["one two one", "", None, "Two é words 日本語 " * 40, "é" * 300, "x" * langid.WIDE, "x" * (langid.WIDE + 1)]
    got = langid.documents(pa.array(texts), net)
    for i, t in enumerate(texts):
        raw = (t or "").lower().encode()
        n, want = -(-len(raw) // langid.WIDE), []
        for k in range(n):  # whole windows with what lies around them
            a, b = k * len(raw) // n, (k + 1) * len(raw) // n
            low, high = max(0, a - langid.CONTEXT), min(len(raw), b + langid.CONTEXT)
            both = np.concatenate([plain_states(net, raw[low:high], d) for d in "fb"], 1)[a - low : b - low]
            e = np.exp(both @ net.p["v"] + net.p["c"])
            want.append(e / e.sum(1, keepdims=True))
        assert np.allclose(got[i], np.concatenate(want).mean(0) if want else 0, atol=1e-5)


# ---- conditional random field


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 700])
def test_marginals(n):
    rng = np.random.default_rng(n)
    score, begins, move, start = rng.normal(size=n) * 2, rng.random(n) < 0.1, rng.normal(size=(2, 2)), 0.7
    begins[0] = True
    p, pairs = toxicity.marginals(score, begins, move, start)
    t, at = np.exp(move), [*np.flatnonzero(begins), n]
    for i, j in zip(at, at[1:], strict=False):
        e = np.stack([np.ones(j - i), np.exp(score[i:j])], 1)
        a, b = np.zeros((j - i, 2)), np.ones((j - i, 2))
        a[0] = e[0] * [1, np.exp(start)]
        for k in range(1, j - i):
            a[k] = a[k - 1] @ t * e[k]
            a[k] /= a[k].sum()
        for k in range(j - i - 2, -1, -1):
            b[k] = t @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        g = a * b
        assert np.allclose(p[i:j], g[:, 1] / g.sum(1))
        for k in range(1, j - i):
            both = a[k - 1][:, None] * t * (e[k] * b[k])[None]
            assert np.allclose(pairs[:, i + k], (both / both.sum()).ravel())


def test_toxic_documents(spark):
    rng = random.Random(2)
    bad = ["grumbus", "grumbol", "grumbix", "vorble"]
    rows, labels = [], []
    for i in range(400):
        words = sentence("en", rng.randrange(10, 60), rng).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, ""), (1001, None), (0, rows[0][1]), (None, "Grumbus grumbol VORBLE"), (1002, sentence("en", 30_000, rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (0, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.tag(df, toxicity.fit(df, lab)).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 60 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and [(s.start, s.end) for s in by[None].spans] == [(0, 22)]
    assert by[1000].score == by[1001].score < 0.3 and by[1002].predicted == 0 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        assert all(text[s.start : s.end].lower().split()[0][:4] in ("grum", "vorb") for s in r.spans) or r.doc_id not in range(400)
    assert toxicity.tag(df.limit(0), None).count() == 0
    assert {r.score for r in toxicity.tag(df, toxicity.fit(df, lab.where("toxic = 1"))).collect()} == {0.0}


def test_folds_agree_with_crc32(spark):
    import zlib

    got = {r.i: r.h for r in spark.range(500).select(F.col("id").alias("i"), common.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(500)}


def test_windows_of_words():
    for _, w in tokens.pieces(pa.array(["a b c d e f", "a b c d e", "a b", "", "b a"])):
        h, first = tokens.windows(w, 5)
        assert np.diff(first).tolist() == [2, 1, 1, 0, 1] and h[0] == h[2] and h[3] != h[4]


def test_scores_against_plain_recursions(spark):
    """Every document's score again, one word after the other, from the chain's weights."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    bad = ["vileword", "nastyness", "grossthing"]
    docs, labels = [], []
    for i in range(240):
        text = [word() for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(bad)
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(900, None), (901, ""), (902, "?!"), (903, " ".join(word() for _ in range(3000)) + " vileword")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = toxicity.fit(df, lab)
    got = {r.doc_id: r for r in toxicity.tag(df, chain).collect()}
    weights = dict(zip(chain.keys.tolist(), chain.weights.tolist(), strict=True))
    for i, t in docs:
        words = (t or "").replace("?!", "").split()
        scores = []
        for w in words:
            for _, x in tokens.pieces(pa.array([w])):
                scores.append(min(20, max(-20, chain.bias + sum(weights.get(int(f[0]), 0.0) for f in toxicity.features(x)))))
        m, n = np.exp(chain.move), len(scores)
        fore, back = np.zeros((n, 2)), np.ones((n, 2))
        for k, s in enumerate(scores):
            fore[k] = ([1, math.exp(chain.start)] if not k else fore[k - 1] @ m) * np.array([1, math.exp(s)])
            fore[k] /= fore[k].sum()
        for k in range(n - 2, -1, -1):
            back[k] = m @ (np.array([1, math.exp(scores[k + 1])]) * back[k + 1])
            back[k] /= back[k].sum()
        p = (fore * back)[:, 1] / (fore * back).sum(1) if n else np.zeros(0)
        x = [math.log1p(p.sum()), math.log1p(100 * p.sum() / max(1, n)), p.max() if n else 0.0]
        want = 1 / (1 + math.exp(-min(30, max(-30, float(np.dot(x, chain.curve[:-1]) + chain.curve[-1])))))
        assert got[i].score == pytest.approx(want, abs=1e-4) and got[i].predicted == int(got[i].score >= toxicity.THRESHOLD)
    held = [got[i] for i, _ in labels if got[i].held_out]
    assert len(held) > 20 and sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
