"""Readers: metasearch answers, issues, questions, pages; and what is made of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed, text, urls

ADDRESS = "struct<house_number:string,road:string,locality:string,postcode:string,country:string>"
RESULT = f"struct<url:string,title:string,content:string,publishedDate:string,published_date:string,score:float,engines:array<string>,doi:string,pdf_url:string,html_url:string,address:{ADDRESS},data:array<struct<key:string,value:string>>,links:string>"
METASEARCH = f"results array<{RESULT}>, unresponsive_engines array<array<string>>"
ISSUES = "items array<struct<title:string,html_url:string,created_at:string,body:string>>"
USER = "struct<display_name:string,link:string>"
ANSWER = f"struct<answer_id:bigint,body_markdown:string,score:bigint,is_accepted:boolean,owner:{USER},content_license:string>"
QUESTIONS = f"items array<struct<question_id:decimal(20,0),title:string,body_markdown:string,link:string,score:bigint,tags:array<string>,is_answered:boolean,owner:{USER},content_license:string,answers:array<{ANSWER}>>>, backoff bigint, quota_remaining bigint"
#: Phrases of pages that show nothing without scripts.
SHELLS = ["enable javascript to run this app", "javascript is required", "please enable javascript", "requires javascript"]


def links(raw: Column) -> Column:
    """Links as array<struct<label,url>>, from a list of such or a map of label to URL."""
    listed = F.from_json(raw, "array<struct<label:string,url:string>>")
    mapped = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("url")))
    return F.when(F.trim(raw).startswith("["), listed).when(F.trim(raw).startswith("{"), mapped)


def metasearch(answers: DataFrame) -> DataFrame:
    """(query_id, pos, ...) from (query_id, body): results in order of score and number of engines, tolerant of missing fields."""
    parsed = answers.select("query_id", F.from_json("body", METASEARCH).alias("r"))
    rows = parsed.select("query_id", F.posexplode("r.results").alias("at", "x")).select("query_id", "at", "x.*").where("url is not null")
    rows = rows.withColumn("date", F.coalesce("publishedDate", "published_date")).drop("publishedDate", "published_date").withColumn("links", links(F.col("links")))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.desc(F.coalesce(F.size("engines"), F.lit(0))), "at")
    return rows.withColumn("pos", F.row_number().over(order) - 1).drop("at")


def search_url(base: str, query: Column, categories: Column, engines: Column, time_range: Column) -> Column:
    """URL of a metasearch request with the filters pushed to it; an empty target adds neither list."""
    add = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"&{name}="), F.url_encode(c))).otherwise("")
    return F.concat(F.lit(f"{base.rstrip('/')}/search?q="), F.url_encode(query), F.lit("&format=json&language=en&safesearch=0"), add("categories", categories), add("engines", engines), add("time_range", time_range))


def hits(rows: DataFrame) -> DataFrame:
    """Rows of ``metasearch`` as candidates: title, date, snippet, URLs to fetch, keys to merge by."""
    official = F.get(F.filter("links", lambda x: F.lower(x["label"]) == "official website"), 0)["url"]
    url = urls.parse(F.coalesce(official, F.col("url")))
    hours = F.get(F.filter("data", lambda d: F.lower(d["key"]).contains("hours")), 0)["value"]
    content = F.nullif(text.strip(F.coalesce("content", F.lit(""))), F.lit(""))
    title = F.coalesce(F.nullif(text.strip(F.coalesce("title", F.lit(""))), F.lit("")), F.lit("Untitled"))
    places = urls.fetch_urls(url, F.col("html_url"), F.col("pdf_url"))
    return rows.where(url.isNotNull()).select(
        "query_id",
        "pos",
        url.alias("url"),
        title.alias("title"),
        F.substring("date", 1, 10).alias("date"),
        F.coalesce(content, text.map_details(F.col("address"), hours), F.lit("")).alias("snippet"),
        text.doi(F.col("doi")).alias("doi"),
        F.concat(F.array(urls.canonical(url)), F.filter(F.transform(places, urls.canonical), lambda k: k != urls.canonical(url))).alias("url_keys"),
        places.alias("fetch_urls"),
        text.title_key(title).alias("title_key"),
        F.lit(False).alias("source_priority"),
        text.engines(F.coalesce("engines", F.array().cast("array<string>"))).alias("engines"),
    )


def issues(answers: DataFrame) -> DataFrame:
    """(query_id, pos, url, title, date, snippet) of an issue tracker's answers; rows without a URL are dropped."""
    rows = answers.select("query_id", F.posexplode(F.from_json("body", ISSUES)["items"]).alias("pos", "x"))
    url = urls.parse(F.col("x.html_url"))
    return rows.where(url.isNotNull()).select("query_id", "pos", url.alias("url"), F.col("x.title").alias("title"), F.substring("x.created_at", 1, 10).alias("date"), F.substring(F.coalesce("x.body", F.lit("")), 1, 800).alias("snippet"))


def excerpt(x: Column, n: int) -> Column:
    flat = text.collapse(x)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def unescaped(x: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def best_answers(answers: Column, n: int = 10) -> Column:
    """Accepted first, then by score, in the given order on ties."""
    numbered = F.transform(answers, lambda a, i: F.struct((~F.coalesce(a["is_accepted"], F.lit(False))).alias("later"), (-F.coalesce(a["score"], F.lit(0))).alias("low"), i.alias("i"), a.alias("a")))
    return F.slice(F.transform(F.sort_array(numbered), lambda x: x["a"]), 1, n)


def attribution(kind: str, owner: Column, score: Column, source: Column, licence: Column) -> Column:
    name = F.regexp_replace(F.coalesce(owner["display_name"], F.lit("unknown")), r"([\[\]\\])", r"\\$1")
    who = F.when(owner["link"].isNotNull(), F.concat(F.lit("["), name, F.lit("]("), owner["link"], F.lit(")"))).otherwise(name)
    return F.concat(F.lit(f"{kind} by "), who, F.lit(" · score "), F.coalesce(score, F.lit(0)).cast("string"), F.coalesce(F.concat(F.lit(" · "), licence), F.lit("")), F.lit(" · <"), F.coalesce(source, F.lit("")), F.lit(">"))


def questions(answers: DataFrame) -> DataFrame:
    """(query_id, pos, url, title, snippet, rendered) of a question-and-answer network's answers."""
    rows = answers.select("query_id", F.posexplode(F.from_json("body", QUESTIONS)["items"]).alias("pos", "x")).select("query_id", "pos", "x.*")
    best = best_answers(F.coalesce("answers", F.array().cast(f"array<{ANSWER}>")))
    top = F.get(best, 0)
    title = unescaped(F.coalesce("title", F.lit("")))
    status = F.concat_ws(" · ", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.concat(F.lit("score "), F.coalesce("score", F.lit(0)).cast("string")), F.when(F.col("is_answered"), "answered").otherwise("unanswered"))
    snippet = F.concat_ws("\n", status, excerpt(F.coalesce("body_markdown", F.lit("")), 400), F.when(top.isNotNull(), excerpt(top["body_markdown"], 800)))
    each = F.transform(best, lambda a: F.concat(F.lit("## Answer\n\n"), attribution("Answer", a["owner"], a["score"], F.col("link"), a["content_license"]), F.lit("\n\n"), F.coalesce(a["body_markdown"], F.lit(""))))
    whole = F.concat(F.lit("# "), title, F.lit("\n\n"), attribution("Question", F.col("owner"), F.col("score"), F.col("link"), F.col("content_license")), F.lit("\n\n"), F.coalesce("body_markdown", F.lit("")), F.when(F.size(each) > 0, F.concat(F.lit("\n\n"), F.array_join(each, "\n\n"))).otherwise(""))
    return rows.where(urls.parse(F.col("link")).isNotNull()).select("query_id", "pos", F.col("link").alias("url"), title.alias("title"), snippet.alias("snippet"), whole.alias("rendered"))


def lookups(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """(site, ids): questions (url) that ``cached`` (site, id) lacks, one request of ids in order per site."""
    refs = wanted.select(urls.question(urls.parse(F.col("url"))).alias("q")).where("q is not null").select("q.site", "q.id").distinct()
    missing = refs.join(cached, ["site", "id"], "left_anti")
    return missing.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ";").alias("ids"))


def page_kind(content_type: Column) -> Column:
    """html, text, pdf, or null for other media types."""
    kind = text.ascii_lower(F.trim(F.substring_index(content_type, ";", 1)))
    return (
        F.when(content_type.isNull() | kind.isin("text/html", "application/xhtml+xml"), "html")
        .when(kind.isin("text/plain", "text/markdown", "text/x-markdown"), "text")
        .when(kind == "application/pdf", "pdf")
    )


def charset(content_type: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1)), F.lit(""))


def decoded(body: Column, content_type: Column) -> Column:
    """Text of a body: by its byte order mark, its declared charset, as UTF-8, else as the western single-byte set."""
    plain = F.when(F.hex(F.substring(body, 1, 3)) == "EFBBBF", F.decode(F.substring(body, 4, 2**31 - 1), "UTF-8"))
    return F.coalesce(plain, F.when(charset(content_type).isin("ISO-8859-1", "LATIN1"), F.decode(body, "ISO-8859-1")), F.when(F.is_valid_utf8(body.cast("string")), F.decode(body, "UTF-8")), F.decode(body, "ISO-8859-1"))


def bounded(pages: DataFrame, body: str = "body", most: int = 5 * 1024 * 1024) -> DataFrame:
    return pages.where(F.octet_length(body) <= most)


def without_scripts(html: Column) -> Column:
    """Script elements out; an unclosed one takes the rest of the page."""
    return F.regexp_replace(html, r"(?is)<script(?=[>/\s]).*?(</script[^>]*>|\z)", "")


def is_shell(markdown: Column) -> Column:
    """Is a short page only the frame of a script?"""
    low = text.ascii_lower(markdown)
    found = F.get(F.filter(text.words_of(SHELLS), lambda p: F.contains(low, p)), 0)
    return F.coalesce((F.length(markdown) <= 1000) & found.isNotNull() & (text.alphanumerics(F.replace(low, found, F.lit(""))) < 200), F.lit(False))


def printer_url(url: Column) -> Column:
    """Export page of a question, an alternate place to fetch it from; null for other pages."""
    q = urls.question(url)
    h = F.regexp_replace(urls.host(url), r"^www\.", "")
    service = F.when(h.endswith(".stackexchange.com"), F.regexp_replace(h, r"\.com$", "")).otherwise(q["site"])
    return F.when(q.isNotNull(), F.concat(F.lit("https://www.stackprinter.com/export?question="), q["id"].cast("string"), F.lit("&service="), service, F.lit("&language=en&hideAnswers=false&showAll=true&width=640")))


def is_outage(content: Column) -> Column:
    low = text.ascii_lower(content)
    return F.exists(text.words_of(fixed.OUTAGES), lambda p: F.contains(low, p))


def is_wall(url: Column, body: Column) -> Column:
    """Known access walls of one forum site."""
    h = urls.host(url)
    phrases = ["you've been blocked by network security", "please wait for verification", "whoa there, pardner"]
    return ((h == "reddit.com") | h.endswith(".reddit.com")) & (urls.path(url).startswith("/login") | F.exists(text.words_of(phrases), lambda p: F.contains(F.lower(body), p)))


def preview(body: Column, n: int = 2048) -> Column:
    """One line of a failed page's body."""
    return F.trim(F.regexp_replace(F.substring(body, 1, n), r"[\p{Cntrl}\s]+", " "))


def readable(html: Column) -> Column:
    """Plain text of a page, in SQL: no scripts, styles, navigation or tags; the article where one is marked."""
    x = F.regexp_replace(without_scripts(html), r"(?is)<(style|nav|footer|aside|form|noscript|template)\b.*?</\1\s*>", " ")
    article = F.regexp_extract(x, r"(?is)<article\b[^>]*>(.*?)(?:</article>|\z)", 1)
    x = F.when(article != "", article).otherwise(x)
    return text.collapse(unescaped(F.replace(F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" "))))


def resolved(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Content of each candidate (query_id, pos, snippet, fetch_urls): the first page longer than the snippet, else that.

    ``pages``: url, content.  Adds url, content, from_snippet."""
    tries = candidates.select("query_id", "pos", "snippet", F.posexplode("fetch_urls").alias("i", "try")).withColumn("key", urls.canonical(F.col("try")))
    found = tries.join(pages.select(urls.canonical(urls.parse(F.col("url"))).alias("key"), "content"), "key").where(F.length(text.strip(F.col("content"))) > F.length("snippet"))
    best = found.groupBy("query_id", "pos").agg(F.min_by(F.struct(F.col("try").alias("url"), "content"), "i").alias("b"))
    out = candidates.drop("url", "fetch_urls").join(best, ["query_id", "pos"], "left")
    return out.withColumn("url", F.coalesce("b.url", F.lit(None))).withColumn("from_snippet", F.col("b").isNull()).withColumn("content", F.coalesce("b.content", "snippet")).drop("b")
