"""Cited sources: the links of pages, followed from page to page for a bounded number of steps.

The frontier is a table: every round joins it with the links of the pages that it has reached, takes off what a page has
reached before, and writes the rest.  A page that very many pages cite is one row of links for each of its links, so
its rows are dealt by the pages that reach it, not gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators.stored import stored

HREF = r"""<a\s[^>]*href="([^"]*)\""""
SITE = r"^https?://([^/?#]+)"


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, target): distinct links of pages (page_id, url, html) to their own site, resolved, without fragments."""
    found = pages.where("url is not null").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href")).where("href <> ''")
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    target = F.regexp_replace(F.when(F.col("href").startswith("/"), F.concat(root, F.col("href"))).otherwise(F.col("href")), "#.*$", "")
    mine = F.regexp_extract("target", SITE, 1) == F.regexp_extract("url", SITE, 1)
    return found.withColumn("target", target).where(F.col("target").rlike("^https?://") & mine).select("page_id", "url", "target").distinct()


def followed(pages: DataFrame, depth: int = 1) -> DataFrame:
    """(page_id, url, depth): what every page leads to in at most ``depth`` steps, with the least number of steps."""
    cited = stored(links(pages), "cited")
    places = pages.select("page_id", "url").where("url is not null")
    reached = stored(cited.select("page_id", F.col("target").alias("url"), F.lit(1).alias("depth")), "reached")
    frontier = reached
    for step in range(2, depth + 1):
        through = frontier.join(places.withColumnRenamed("page_id", "via"), "url").select("page_id", "via")
        onward = through.join(cited.select(F.col("page_id").alias("via"), "target"), "via").select("page_id", F.col("target").alias("url")).distinct()
        frontier = stored(onward.join(reached.select("page_id", "url"), ["page_id", "url"], "left_anti").withColumn("depth", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def scored(found: DataFrame) -> DataFrame:
    """(page_id, url, depth, score): deeper paths are more specific sources."""
    parts = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda s: s != ""))
    return found.select("page_id", "url", "depth", F.round(0.025 * F.least(parts, F.lit(6)), 6).alias("score"))
