"""Choices of chunks against plain loops that go through the rules one chunk at a time."""

from __future__ import annotations

import random

import pytest

from millrace.operators import chunking, rank


def cap(rows, limit):
    """Ordinals kept of one document; rows: (ordinal, lexical, seed)."""
    rows = sorted(rows)
    n, half = len(rows), (limit + 1) // 2
    if n <= limit:
        return [r[0] for r in rows]
    by_score = sorted((k for k in range(n) if rows[k][1] > 0), key=lambda k: (-rows[k][1], k))
    seeds = [k for k in by_score if rows[k][2]][:half]
    wanted = list(seeds)
    for d in range(1, n):
        for s in seeds:
            wanted += [k for k in (s + d, s - d) if 0 <= k < n]
    taken = []
    for k in wanted + by_score:
        if k not in taken and len(taken) < half:
            taken.append(k)
    rest = limit - len(taken)
    even = [n - 1] if rest == 1 else [k * (n - 1) // (rest - 1) for k in range(rest)]
    for k in even + list(range(n)):
        if k not in taken and len(taken) < limit:
            taken.append(k)
    return sorted(rows[k][0] for k in taken)


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 8])
def test_chunk_cap(spark, limit):
    draw = random.Random(limit)
    docs = {}
    for d in range(150):
        odds = draw.choice([0, 0, 0.1, 0.5])
        docs[d] = [(3 * k, draw.choice([0.0, 0.0, 0.25, 0.5, draw.random()]), draw.random() < odds) for k in range(draw.choice([0, 1, 2, limit, limit + 1, 9, 20, 60]))]
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc_id int, ordinal int, lexical double, seed boolean")
    got = {}
    for r in chunking.capped(df, limit).collect():
        got.setdefault(r.doc_id, []).append(r.ordinal)
    assert {d: sorted(x) for d, x in got.items()} == {d: cap(rows, limit) for d, rows in docs.items() if rows}


def test_chunk_cap_of_odd_rows(spark):
    odd = [(1, k, None if k % 2 else 0.5, None) for k in range(6)] + [(None, k, 0.1 * k, k == 2) for k in range(6)]
    got = chunking.capped(spark.createDataFrame(odd, "doc_id int, ordinal int, lexical double, seed boolean"), 4).collect()
    assert sorted(r.ordinal for r in got if r.doc_id == 1) == [0, 1, 2, 5]
    assert sorted(r.ordinal for r in got if r.doc_id is None) == [0, 2, 3, 5]
    assert chunking.capped(spark.createDataFrame([], "doc_id int, ordinal int, lexical double, seed boolean")).collect() == []


def choose(rows, per_document, total):
    """(doc, ordinal) in the order of choice for one query; rows: (doc, ordinal, score, seed), all of them."""
    order = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    docs = sorted({r[0] for r in rows})
    heads = [next((r for r in order if r[0] == d and r[3]), next(r for r in order if r[0] == d)) for d in docs]
    chosen = sorted(heads, key=lambda r: (-r[2], r[0]))[:total]
    own = lambda d: [r for r in chosen if r[0] == d]
    beside = lambda r: any(abs(r[1] - x[1]) == 1 for x in own(r[0]))
    named = [r[0] for r in chosen if r[3]]
    for d in named:
        while len(own(d)) < per_document and len(chosen) < total:
            free = [r for r in order if r[0] == d and r not in chosen and beside(r)]
            if not free:
                break
            chosen.append(min(free, key=lambda r: (not r[3], -r[2], r[1])))
    for r in order:
        if len(chosen) < total and own(r[0]) and len(own(r[0])) < per_document and r not in chosen and (r[0] not in named or beside(r)):
            chosen.append(r)
    return [(r[0], r[1]) for r in chosen]


@pytest.mark.parametrize(("per_document", "total"), [(3, 24), (1, 5), (4, 7), (2, 1)])
def test_adjacent_chunks(spark, per_document, total):
    draw = random.Random(total)
    queries = {}
    for q in range(60):
        odds = draw.choice([0, 0.05, 0.3])
        queries[q] = [(d, k, draw.choice([0.5, round(draw.random(), 2)]), draw.random() < odds) for d in range(draw.choice([1, 3, 12, 40])) for k in range(draw.choice([1, 2, 9])) if draw.random() < 0.9]
    df = spark.createDataFrame([(q, *r) for q, rows in queries.items() for r in rows], "query_id int, doc_id int, ordinal int, score double, seed boolean")
    got = {}
    for r in sorted(rank.adjacent_chunks(df, per_document, total).collect(), key=lambda r: (r.query_id, r.selected)):
        got.setdefault(r.query_id, []).append((r.doc_id, r.ordinal))
    assert got == {q: choose(rows, per_document, total) for q, rows in queries.items() if rows}


def test_groups_are_cut_before_they_meet(spark):
    """A query with many documents of many chunks reaches the fold with a bounded number of rows."""
    df = spark.range(20_000).selectExpr("1 AS query_id", "id div 100 AS doc_id", "cast(id % 100 AS int) AS ordinal", "rand(7) AS score", "id % 37 = 0 AS seed")
    plan = rank.adjacent_chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "dense_rank" in plan
    assert rank.adjacent_chunks(df).count() == 24
