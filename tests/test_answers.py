"""The data source of answers: what is pushed, what is visible, what aborted writes leave."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from millrace.sources import answers, scans


@pytest.fixture
def source(spark):
    spark.dataSource.register(answers.AnswersSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda path: spark.read.format("answers").option("path", path).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def write(df, path):
    df.write.format("answers").option("path", path).mode("append").save()


def test_rows_come_back(spark, source, tmp_path):
    path = f"file://{tmp_path}/a"
    assert source(path).count() == 0
    body = json.dumps({"results": [{"url": "https://example.com/é", "title": "T\n", "score": 1}]}, ensure_ascii=False)
    rows = [(i, body) for i in range(40)] + [(None, "x\ny"), (7, None)]
    df = spark.createDataFrame(rows, answers.SCHEMA)
    write(df.repartitionByRange(4, "query_id"), path)
    assert sorted(map(tuple, source(path).collect()), key=repr) == sorted(rows, key=repr)
    assert sorted(r.query_id for r in source(path).where("query_id = 7").collect()) == [7, 7]
    assert source(path).where("query_id >= 30 and query_id in (1, 35, 50)").count() == 1
    assert scans.hits(scans.metasearch(source(path).where("query_id < 3"))).select("url").distinct().collect()[0][0] == "https://example.com/é"
    write(df.limit(2), path)
    assert source(path).count() == len(rows) + 2
    assert source(path).select(F.max("query_id")).first()[0] == 39


def test_filters_leave_files_out(spark, source, tmp_path):
    path = f"file://{tmp_path}/b"
    write(spark.range(400).select(F.col("id").alias("query_id"), F.lit("x").alias("body")).repartitionByRange(8, "query_id"), path)

    def files(*filters):
        r = answers.AnswersReader(path)
        assert list(r.pushFilters(list(filters))) == list(filters)
        return len([p for p in r.partitions() if p.file])

    whole, name = files(), ("query_id",)
    assert whole > 4
    assert files(EqualTo(name, 10)) == 1 and files(In(name, (1, 399))) == 2
    assert files(GreaterThanOrEqual(name, 350), IsNotNull(name)) < whole / 2
    assert files(GreaterThanOrEqual(name, 1000)) == 0 and files(EqualTo(("body",), "x")) == whole
    assert files(LessThan(name, 1)) == 1


def test_aborted_writes_leave_nothing(spark, source, tmp_path):
    path = f"file://{tmp_path}/c"
    write(spark.createDataFrame([(1, "a")], answers.SCHEMA), path)
    bad = spark.range(100).repartition(4).select(F.col("id").alias("query_id"), F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise("b").cast("string").alias("body"))
    with pytest.raises(Exception, match="no"):
        write(bad, path)
    assert [tuple(r) for r in source(path).collect()] == [(1, "a")]
    assert len(os.listdir(tmp_path / "c" / "manifests")) == 1
    w = answers.AnswersWriter(path)
    row = type("Row", (), {"query_id": 9, "body": "z"})
    m = w.write([row])
    assert (tmp_path / "c" / m.file).exists()
    w.abort([m, None])
    assert not (tmp_path / "c" / m.file).exists() and source(path).count() == 1
    with pytest.raises(Exception, match="appended"):
        spark.createDataFrame([(1, "a")], answers.SCHEMA).write.format("answers").option("path", path).mode("overwrite").save()
