"""Every base query against its SQL twin on the smallest tables."""

import json
import os
from pathlib import Path

import duckdb
import pytest

from millrace.plans import registry
from tests import literals
from tests.rows import rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    got = registry.queries()[name](spark, SF)
    assert got.collect()


#: Recorded rows of literal cases (``tests/literals.py``): a change in them has to be looked at.
EXPECTED = json.loads((Path(__file__).parent / "expected.json").read_text())


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_literals(spark, monkeypatch, name):
    got = literals.CASES[name](spark, monkeypatch)
    assert sorted(got.columns) == EXPECTED[name]["columns"]
    assert json.loads(json.dumps(rows(got.columns, [tuple(r) for r in got.collect()]))) == EXPECTED[name]["rows"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
