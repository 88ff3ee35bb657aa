"""Queries against their SQL on small tables with rows that only large tables have by chance."""

import struct

import duckdb
import numpy as np
import pytest

from millrace.plans import registry


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(folder)), con.sql(registry.oracle_sql()[name])

    def exact(v):  # signs of zeros count
        return tuple(map(exact, v)) if isinstance(v, (list, tuple)) else repr(v)

    return sorted(exact(tuple(r[c] for c in want.columns)) for r in got.collect()), sorted(map(exact, want.fetchall()))


@pytest.mark.parametrize("name", ["v6_shortened", "v12_gelu", "v12_unary", "v13_binary", "v15_total", "v17_gather", "v21_cast", "v22_narrow"])
def test_small_negative_numbers_and_floats(spark, tmp_path, name):
    rng = np.random.default_rng(0)
    vectors = np.where(rng.random((300, 64)) < 0.5, rng.normal(0, 3e-7, (300, 64)), (rng.integers(-300, 300, (300, 64)) / 1000).astype(np.float32))
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v], 0) for i, v in enumerate(vectors.tolist())]
    got, want = same_as_sql(spark, tmp_path, name, {"embeddings": spark.createDataFrame([*rows, (300, [-1e-9] * 64, 0)], "vec_id long, embedding array<float>, label int")})
    assert got == want


def test_brackets_in_pdf_titles(spark, tmp_path):
    pages = [(1, "https://example.com/(a)", "<title>Call +1 (984) 555 \\ ((now</title>"), (2, "https://example.com/b", "<title>) ok (</title>")]
    got, want = same_as_sql(spark, tmp_path, "s19_pdf", {"pages": spark.createDataFrame(pages, "page_id long, url string, html string")})
    assert got == want
