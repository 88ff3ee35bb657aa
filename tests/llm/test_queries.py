"""The registered queries on the smallest tables, with their SQL where there is some; the pipeline stage by stage."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import neardup, queries
from tests.llm.test_neardup import brute
from tests.llm.test_simple import contaminated
from tests.rows import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op1_decontaminate"}))
def test_one_row_each(spark, duck, name):
    table, key = ("pages", "page_id") if name.startswith("op6") else ("documents", "doc_id")
    got = sorted(r[0] for r in queries.queries()[name](spark, SF).select(key).collect())
    assert got == [r[0] for r in duck.sql(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]


def test_decontamination_query(spark, duck):
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op1_decontaminate"](spark, SF).collect()}
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    grams = {}
    for j, t in items:  # a shared run of four words is needed; then every place is compared
        w = re.findall(r"\w+", t.lower())
        for k in range(len(w) - 3):
            grams.setdefault(tuple(w[k : k + 4]), set()).add(j)
    texts, want = dict(items), set()
    for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        w = re.findall(r"\w+", t.lower())
        near = set().union(*(grams.get(tuple(w[k : k + 4]), ()) for k in range(len(w) - 3)))
        want |= {(i, j) for j in near if contaminated(t, texts[j])}
    assert got == want


def test_classes_query(spark, duck):
    docs = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = {r.doc_id: r.class_id for r in queries.queries()["op8_neardup"](spark, SF).collect()}
    assert [got[i] for i, _ in docs] == [docs[k][0] for k in brute([t for _, t in docs])]


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = {r[0] for r in duck.sql("SELECT doc_id FROM labels WHERE quality = 0").fetchall()}
    good = {r[0] for r in duck.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    ids = lambda d: [r.doc_id for r in d.select("doc_id").collect()]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality classifier"](spark, docs, SF).cache()
    assert one.columns == docs.columns and good - set(ids(one)) == set() or len(good - set(ids(one))) <= 0.03 * len(good)
    assert len(junk & set(ids(one))) <= 0.5 * len(junk)
    two = stage["near-duplicates"](spark, one, SF).cache()
    classes = {r.doc_id: r.class_id for r in neardup.classes(one).collect()}
    assert sorted(ids(two)) == sorted(set(classes.values()))
    three = stage["decontamination"](spark, two, SF).cache()
    leaks = {r.doc_id for r in queries.queries()["op1_decontaminate"](spark, SF).collect()}
    assert set(ids(three)) == set(ids(two)) - leaks
    four = stage["mixing"](spark, three, SF).cache()
    assert four.columns == docs.columns and set(ids(four)) <= set(ids(three))
    assert max(ids(four).count(i) for i in set(ids(four))) <= 3
    five = stage["token ids"](spark, four, SF).collect()
    assert sorted(r.doc_id for r in five) == sorted(ids(four))


def test_pipeline_on_strange_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts and sources, ties, an empty table: each stage has a result."""
    words = "the quick brown fox jumps over a lazy dog near some river bank while birds sing".split()
    good = [(i, " ".join(words[(i * 3 + k * (1 + i % 5)) % len(words)] + str((i * k) % 7) for k in range(60)), "en", f"s{i % 3}" if i % 4 else None) for i in range(40)]
    docs = [*good, (None, good[1][1], "en", "s1"), (5, good[5][1], "en", "s2"), (100, None, None, None), (101, "", "en", "s1"), (102, good[2][1] + " " + "a passage of the benchmark that must not be learned by any model at all here", "en", "s2")]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    for name, rows_ in (("some", docs), ("none", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, len(r[1] or "")) for r in rows_], schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "passage of the benchmark that must not be learned by any model at all"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        ids = {r.doc_id for r in out}
        assert ids <= {r[0] for r in rows_} and not ids & {100, 101, 102}
        assert len(ids) >= 0.5 * len({r[0] for r in good if rows_})
        at = 0
        for r in sorted(out, key=lambda r: r.start):
            assert r.start == at and r.n_tokens > 1
            at += r.n_tokens


def test_quality_rejects_repeated_words_too(spark, duck):
    sf = SF.replace("sf0.001", "sf0.01")
    kept = {r.doc_id: r.keep for r in queries.queries()["op3_quality"](spark, sf).collect()}
    labels = duck.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    junk, good = ([kept[i] for i, q in labels if q == quality] for quality in (0, 1))
    assert sum(junk) <= 0.04 * len(junk) and sum(good) >= 0.98 * len(good)
