"""Signatures, the exact parts and whole classes against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from millrace.llm import neardup, tokens


def words(n, rng, size=20_000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(base, k, rng):
    out = list(base)
    for j in rng.sample(range(len(base)), k):
        out[j] = f"x{rng.randrange(10**9)}"
    return out


def unit_sets(texts):
    out = []
    for _, w in tokens.pieces(pa.array(texts, pa.string())):
        e, first = neardup.units(w)
        out += [set(e[first[i] : first[i + 1]].tolist()) for i in range(len(first) - 1)]
    return out


def plain_sets(texts):
    """Runs of five words with the number of each repetition, from strings; shares no code with the operator."""
    out = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        seen = Counter()
        runs = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        units = set()
        for r in runs:
            seen[r] += 1
            units.add((r, seen[r]))
        out.append(units)
    return out


def brute(texts):
    sets = plain_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) or not sets[i] and not sets[j] and (texts[i] or "") == (texts[j] or ""):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    base = words(250, rng)
    texts = [" ".join(base)] + [" ".join(edited(base, k, rng)) for k in range(0, 40, 2)]
    sets = unit_sets(texts)
    for _, w in tokens.pieces(pa.array(texts)):
        s = neardup.signatures(*neardup.units(w))
    errors = [(s[0] == s[i]).mean() - len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in range(1, len(texts))]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


def test_weights_count():
    texts = ["a b c d e " * 40, "a b c d e " * 20]
    x, y = unit_sets(texts)
    assert abs(len(x & y) / len(x | y) - 0.5) < 0.03


def test_overlap_of_multisets():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.sort(rng.integers(0, 30, rng.integers(0, 40)).astype(np.uint32)) for _ in range(2))
        want = sum(min((a == v).sum(), (b == v).sum()) for v in range(30))
        assert neardup.overlap(a, b) == want


def test_spanning_links():
    sets = [np.arange(100, dtype=np.uint32), np.arange(5, 105, dtype=np.uint32), np.arange(60, 160, dtype=np.uint32), np.arange(0, 100, dtype=np.uint32)]
    got = neardup.spanning_links([1, 2, 3, 4], [1, 2, 3, 1], sets)
    assert len(got) == 1 and 2 in got[0]


def corpus():
    rng = random.Random(9)
    docs = []
    hub = words(150, rng)
    docs += [edited(hub, k % 7, rng) for k in range(90)]  # around a hub: near and not so near copies
    chain = words(150, rng)
    for _ in range(12):  # each similar to the next one only
        chain = edited(chain, 2, rng)
        docs.append(chain)
    passage = words(60, rng)
    docs += [passage + words(50, rng) for _ in range(90)]  # a passage that many share, no duplicates
    docs += [words(40, rng) for _ in range(10)] + [["a", "b"], ["a", "b"], ["a", "c"]]
    texts = [" ".join(d) for d in docs] + ["", None, "?!", "", " ".join(hub).upper()]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i] for i in order]


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 16)  # small groups reach all the ways of splitting buckets
    texts = corpus()
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_texts_that_some_hashes_confuse(spark):
    bits = [bin(i).count("1") % 2 for i in range(1 << 11)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, a), (2, b), (3, a + "!"), (4, f"one two three {a} four five"), (5, f"one two three {b} four five")]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_very_long_texts_and_ties(spark):
    rng = random.Random(3)
    long = words(60_000, rng)
    texts = [" ".join(long), " ".join(edited(long, 300, rng)), "same same", "same, same", " ".join(long[:30_000])]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == [0, 0, 2, 2, 4] == brute(texts)


def test_representatives_and_strange_ids(spark):
    same = "one two three four five six seven eight"
    rows = [(1, same, "en"), (2, same + "!", "en"), (2, "other words here entirely now and then", "fr"), (None, same, None), (5, None, "de"), (5, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(((r.doc_id, r.text) for r in neardup.representatives(df).collect()), key=str)
    assert kept == sorted([(1, same), (2, "other words here entirely now and then"), (5, None)], key=str)
    assert neardup.representatives(df.limit(0)).count() == 0 and neardup.classes(df.limit(0)).count() == 0


def test_representatives_keep_columns_of_any_name(spark):
    same, names = "one two three four five six seven eight", ["__digest", "__id", "__head", "row", "id", "digest", "class_id", "class_digest", "key", "n", "signature"]
    ids = [(1, same), (2, same + "!"), (2, "other words here entirely now and then"), (None, same), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(*x, *[f"{n}{i}" for n in names]) for i, x in enumerate(ids)], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    got = neardup.representatives(df)
    assert sorted(got.columns) == sorted(df.columns)
    given = {tuple(r) for r in df.select(sorted(df.columns)).collect()}
    kept = [tuple(r) for r in got.select(sorted(df.columns)).collect()]
    assert len(kept) == len(set(kept)) == 3 and set(kept) <= given
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [1, 2, 5]
