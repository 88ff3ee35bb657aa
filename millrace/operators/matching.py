"""Ordered matching of results that are one thing, as joins: no query's rows meet in one task.

In order of position a row joins the thing of an earlier row: by the first of its URL keys that an earlier row has, else by its
DOI, else by an equivalent title of a founder (a row that joined none); founders with the smallest position win.  A row that joins
brings its keys and its DOI, but not its title, into the thing.

By keys and DOI only the first row that has them matters, so those parents are grouped minima.  By titles it matters who is a
founder.  Only the first row without an earlier key of each distinct title can be one; equivalent titles are a title and
its prefixes of two thirds of its words or more, so candidates are an equi-join on such prefixes, and rounds settle
titles whose earlier rivals are settled.  At last rows follow their parents to a founder, twice as far each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.stored import stored

UNTITLED = "untitled"


def key_parents(rows: DataFrame) -> DataFrame:
    """(query_id, pos, parent) of rows with an earlier row of one of their keys, or else of their DOI."""
    keyed = rows.select("query_id", "pos", F.posexplode("url_keys").alias("at", "key")).where("key is not null")
    first = keyed.groupBy("query_id", "key").agg(F.min("pos").alias("parent"))
    by_key = keyed.join(first, ["query_id", "key"]).where("parent < pos").groupBy("query_id", "pos").agg(F.min_by("parent", "at").alias("by_key"))
    dois = rows.where("doi is not null and doi <> ''").select("query_id", "pos", "doi")
    doi_first = dois.groupBy("query_id", "doi").agg(F.min("pos").alias("by_doi"))
    by_doi = dois.join(doi_first, ["query_id", "doi"]).where("by_doi < pos").select("query_id", "pos", "by_doi")
    return by_key.join(by_doi, ["query_id", "pos"], "full").select("query_id", "pos", F.coalesce("by_key", "by_doi").alias("parent"))


def equivalents(titles: DataFrame) -> DataFrame:
    """(query_id, title, other): distinct titles (query_id, title) that are equivalent, one a prefix of the other's words."""
    words = F.split("title", " ")
    n = F.size(words)
    least = F.greatest(F.lit(4), F.ceil(2 * n / 3).cast("int"))
    cuts = F.when(least < n, F.sequence(least, n - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = titles.select("query_id", "title", F.explode(F.transform(cuts, lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("other"))
    down = prefixes.join(titles.withColumnRenamed("title", "other"), ["query_id", "other"], "left_semi").select("query_id", "title", "other")
    return down.unionByName(down.select("query_id", F.col("other").alias("title"), F.col("title").alias("other")))


def founders(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, title, pos) of founders with a title, (query_id, title, other) of equivalent titles) of rows without a parent by key."""
    firsts = stored(open_rows.groupBy("query_id", "title").agg(F.min("pos").alias("pos")), "title-firsts")
    near = stored(equivalents(firsts.select("query_id", "title")), "title-pairs")
    rivals = near.join(firsts, ["query_id", "title"]).join(firsts.select("query_id", F.col("title").alias("other"), F.col("pos").alias("before")), ["query_id", "other"])
    rivals = stored(rivals.where("before < pos").select("query_id", "title", "other"), "title-rivals")
    # 1: founder, 0: not, null: open.
    state = stored(firsts.withColumn("founder", F.lit(None).cast("int")), "title-state")
    while True:
        seen = rivals.join(state.select("query_id", F.col("title").alias("other"), "founder"), ["query_id", "other"]).groupBy("query_id", "title").agg(F.max("founder").alias("lost"), F.count(F.when(F.col("founder").isNull(), 1)).alias("waiting"))
        settled = F.when(F.col("lost") == 1, 0).when(F.coalesce("waiting", F.lit(0)) == 0, 1)
        state = stored(state.join(seen, ["query_id", "title"], "left").select("query_id", "title", "pos", F.coalesce("founder", settled).alias("founder")), "title-state")
        if state.where("founder is null").isEmpty():
            return state.where("founder = 1").select("query_id", "title", "pos"), near


def matched(results: DataFrame) -> DataFrame:
    """(query_id, pos, founder): the position of the founder of every result's thing.

    ``results``: query_id, pos (distinct within a query), url_keys, doi, title_key; rows without a query or position are left out."""
    rows = results.where("query_id is not null and pos is not null").select("query_id", "pos", "url_keys", "doi", F.col("title_key").alias("title"))
    rows = stored(rows, "results")
    parents = stored(key_parents(rows), "key-parents")
    titled = rows.where(f"title is not null and title <> '' and title <> '{UNTITLED}'").select("query_id", "pos", "title").join(parents, ["query_id", "pos"], "left_anti")
    found, near = founders(titled)
    own = titled.join(found.withColumnRenamed("pos", "founder"), ["query_id", "title"])
    other = titled.join(near, ["query_id", "title"]).join(found.select("query_id", F.col("title").alias("other"), F.col("pos").alias("founder")), ["query_id", "other"])
    by_title = own.select("query_id", "pos", "founder").unionByName(other.select("query_id", "pos", "founder")).where("founder < pos").groupBy("query_id", "pos").agg(F.min("founder").alias("parent"))
    pointers = rows.select("query_id", "pos").join(parents.unionByName(by_title), ["query_id", "pos"], "left").select("query_id", "pos", F.coalesce("parent", "pos").alias("founder"))
    while True:
        pointers = stored(pointers, "pointers")
        next_ = pointers.select("query_id", F.col("pos").alias("founder"), F.col("founder").alias("further"))
        moved = pointers.join(next_, ["query_id", "founder"]).select("query_id", "pos", F.col("further").alias("founder"), (F.col("further") < F.col("founder")).alias("moves"))
        moved = stored(moved, "pointers")
        if moved.where("moves").isEmpty():
            return moved.select("query_id", "pos", "founder")
        pointers = moved.select("query_id", "pos", "founder")


def things(results: DataFrame) -> DataFrame:
    """(query_id, founder, url, title, date, snippet, source_priority, rows, keys): every thing by its founder, with the newest
    date, the first snippet that is not empty, flags or-ed, and how many rows and distinct URL keys it has."""
    who = matched(results)
    rows = results.join(who, ["query_id", "pos"])
    keys = rows.select("query_id", "founder", F.explode("url_keys").alias("key")).distinct().groupBy("query_id", "founder").agg(F.count("key").alias("keys"))
    first = F.min_by(F.struct("url", "title"), "pos")
    said = F.min_by("snippet", F.when(F.coalesce("snippet", F.lit("")) != "", F.col("pos")))
    said = F.when(F.max(F.coalesce("snippet", F.lit("")) != ""), said).otherwise("")
    out = rows.groupBy("query_id", "founder").agg(first.alias("f"), F.max("date").alias("date"), said.alias("snippet"), F.max(F.coalesce("source_priority", F.lit(False))).alias("source_priority"), F.count(F.lit(1)).alias("rows"))
    return out.join(keys, ["query_id", "founder"], "left").select("query_id", "founder", "f.url", "f.title", "date", "snippet", "source_priority", "rows", F.coalesce("keys", F.lit(0)).alias("keys"))
