"""Diagnostics: one row per extraction, failed fetch or scan, keyed by a digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scans import preview

KINDS = {"timeout": 504, "backend": 502, "invalid": 400, "internal": 500}


def key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def extractions(pages: DataFrame) -> DataFrame:
    """(key, url, html, markdown, rawByteLength, extractedCharLength, ratio) of (url, html, markdown)."""
    raw, got = F.octet_length("html"), F.length("markdown")
    return pages.select(key(F.col("url")).alias("key"), "url", "html", "markdown", raw.alias("rawByteLength"), got.alias("extractedCharLength"), F.when(raw > 0, got / raw).otherwise(0.0).alias("ratio"))


def failures(fetches: DataFrame) -> DataFrame:
    """Failed fetches of (url, status, content_type, body, error) with a preview of their body."""
    return fetches.where("error is not null").select(key(F.col("url")).alias("key"), "url", "status", "content_type", preview(F.col("body")).alias("preview"), "error")


def scans(answers: DataFrame) -> DataFrame:
    """(key, query, target, result_count, contributors) of (query, target, results)."""
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("results", lambda r: r["engines"]))))
    return answers.select(key(F.col("target"), F.col("query")).alias("key"), "query", "target", F.size("results").alias("result_count"), names.alias("contributors"))


def error(kind: Column, message: Column) -> Column:
    """(status, body) of an error; details of backend and internal errors stay inside."""
    status = F.lit(500)
    for k, v in KINDS.items():
        status = F.when(kind == k, v).otherwise(status)
    shown = F.when(kind.isin("backend", "internal"), F.concat(kind, F.lit(" error"))).otherwise(message)
    return F.struct(status.alias("status"), F.to_json(F.struct(kind.alias("error"), shown.alias("message"))).alias("body"))


def write(df: DataFrame, path: str) -> None:
    """Append diagnostics as JSON lines; a failure to write does not fail the search."""
    import logging

    try:
        df.write.mode("append").json(path)
    except Exception:
        logging.getLogger(__name__).exception("diagnostics were not written")
