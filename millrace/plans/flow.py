"""Queries of sources, sinks, caches, pacing, streams and the embedder."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import embed, encoder, fixed
from millrace.operators import cache, dedup
from millrace.operators.stored import folder
from millrace.plans import scalars, search
from millrace.plans.registry import query, table
from millrace.sources import answers as stored_answers
from millrace.sources import markdown, pdf, scans, sinks

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
title = lambda: F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def answers(spark, sf_dir):
    """(query_id, body): ten pages as the answer of a metasearch service, with fields that some lack or write otherwise."""
    k = F.col("page_id")
    engines = F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.concat(F.lit(" Engine"), i.cast("string")))
    found = F.struct(
        k.alias("k"),
        "url",
        F.when(k % 7 != 0, title()).alias("title"),
        F.when(k % 5 != 0, F.concat(F.lit(" "), title(), F.lit(" "))).alias("content"),
        F.when(k % 4 == 0, F.lit("2024-05-06T01:02")).alias("publishedDate"),
        F.when(k % 4 == 1, F.lit("2023-01-02")).alias("published_date"),
        ((k % 3) / 2).alias("score"),
        engines.alias("engines"),
        F.when(k % 6 == 0, F.concat(F.lit("doi:10.1/X"), k.cast("string"))).alias("doi"),
        F.when(k % 8 == 0, F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit(".pdf"))).alias("pdf_url"),
        k.alias("unknown"),
    )
    rows = table(spark, sf_dir, "pages").where("url is not null").groupBy(F.floor(k / 10).alias("query_id")).agg(F.sort_array(F.collect_list(found)).alias("results"))
    return rows.select("query_id", F.to_json(F.struct("results", F.array(F.array(F.lit("slow"), F.lit("timeout"))).alias("unresponsive_engines"))).alias("body"))


@query("s1_metasearch", f"""WITH r AS (SELECT page_id // 10 AS query_id, page_id AS k, url, {TITLE} AS t FROM pages WHERE url IS NOT NULL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k % 3 DESC, k) - 1 AS INT) AS pos, regexp_replace(url, '#.*$', '') AS url, CASE WHEN k % 7 = 0 OR trim(t) = '' THEN 'Untitled' ELSE trim(t) END AS title,
  CASE k % 4 WHEN 0 THEN '2024-05-06' WHEN 1 THEN '2023-01-02' END AS date, CASE WHEN k % 5 = 0 THEN '' ELSE trim(t) END AS snippet, CASE WHEN k % 6 = 0 THEN '10.1/x' || k END AS doi,
  CASE WHEN k % 8 = 0 THEN regexp_replace(url, '[?#].*', '') || '.pdf ' ELSE '' END || regexp_replace(url, '#.*$', '') AS places FROM r""")
def s1_metasearch(spark, sf_dir):
    """Metasearch answers as ordered candidates."""
    return scans.hits(scans.metasearch(answers(spark, sf_dir))).select("query_id", "pos", "url", "title", "date", "snippet", "doi", F.array_join("fetch_urls", " ").alias("places"))


@query("s1_stored_scan", "SELECT page_id // 10 AS query_id, count(*) AS results, min(regexp_replace(url, '#.*$', '')) AS first FROM pages WHERE url IS NOT NULL AND page_id // 10 >= 5 GROUP BY 1")
def s1_stored_scan(spark, sf_dir):
    """Answers written through the data source, and a scan of some of them with a filter that it takes."""
    spark.dataSource.register(stored_answers.AnswersSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = folder(spark, "answers")
    answers(spark, sf_dir).repartitionByRange("query_id").write.format("answers").option("path", path).mode("append").save()
    found = spark.read.format("answers").option("path", path).load().where("query_id >= 5")
    return scans.hits(scans.metasearch(found)).groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.min("url").alias("first"))


_encoded = "replace(replace(replace(url_encode(query), '%20', '+'), '%2A', '*'), '~', '%7E')"


@query("s3_search_urls", f"WITH {scalars.Q_SQL} SELECT query_id, 'http://search.example/search?q=' || {_encoded} || '&format=json&language=en&safesearch=0' || CASE WHEN query_id % 2 = 0 THEN '&categories=it' ELSE '' END || CASE WHEN query_id % 5 = 0 THEN '&time_range=year' ELSE '' END AS url FROM q")
def s3_search_urls(spark, sf_dir):
    none = F.lit(None).cast("string")
    q = F.col("query_id")
    return scalars.questions(spark, sf_dir).select("query_id", scans.search_url("http://search.example", F.col("query"), F.when(q % 2 == 0, "it"), none, F.when(q % 5 == 0, "year")).alias("url"))


@query("s5_issues", "SELECT doc_id AS query_id, CAST(0 AS INT) AS pos, 'https://github.com/o/r/issues/' || doc_id AS url, 'Issue ' || doc_id AS title, '2024-01-02' AS date, substr(coalesce(text, ''), 1, 800) AS snippet FROM documents WHERE doc_id % 7 <> 0")
def s5_issues(spark, sf_dir):
    """Documents as answers of an issue tracker; every seventh has no address."""
    k = F.col("doc_id").cast("string")
    item = F.struct(F.concat(F.lit("Issue "), k).alias("title"), F.when(F.col("doc_id") % 7 == 0, "nope").otherwise(F.concat(F.lit("https://github.com/o/r/issues/"), k)).alias("html_url"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.col("text").alias("body"))
    return scans.issues(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("body")))


def threads(spark, sf_dir):
    """(query_id, body): conversations as answers of a question-and-answer network: what the assistant says are the answers."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    said = F.struct(turn.alias("answer_id"), F.col("text").alias("body_markdown"), (turn % 5).alias("score"), (turn == 3).alias("is_accepted"))
    t = c.groupBy("conv_id").agg(F.min_by(F.struct("text"), F.when(F.col("role") == "user", turn)).alias("q"), F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", said))).alias("answers"))
    k = F.col("conv_id")
    item = F.struct(k.alias("question_id"), F.lit("Why &lt;b&gt;?").alias("title"), F.col("q.text").alias("body_markdown"), F.concat(F.lit("https://stackoverflow.com/q/"), k.cast("string")).alias("link"), (k % 9).alias("score"), F.array(F.lit("x"), F.lit("y")).alias("tags"), (k % 2 == 0).alias("is_answered"), F.struct(F.lit("A]B").alias("display_name")).alias("owner"), "answers")
    return t.select(k.alias("query_id"), F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))


_rank = "row_number() OVER (PARTITION BY conv_id ORDER BY turn = 3 DESC, turn % 5 DESC, turn)"


@query("s6_questions", rf"""WITH a AS (SELECT conv_id, text, {_rank} AS n, turn % 5 AS s FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, string_agg(chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || 'Answer by unknown · score ' || s || ' · <https://stackoverflow.com/q/' || conv_id || '>' || chr(10) || chr(10) || coalesce(text, ''), '' ORDER BY n) AS body FROM a WHERE n <= 10 GROUP BY conv_id),
q AS (SELECT conv_id, min_by(coalesce(text, ''), turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT q.conv_id AS query_id, CAST(0 AS INT) AS pos, 'https://stackoverflow.com/q/' || q.conv_id AS url, 'Why <b>?' AS title,
  md5('# Why <b>?' || chr(10) || chr(10) || 'Question by A\]B · score ' || q.conv_id % 9 || ' · <https://stackoverflow.com/q/' || q.conv_id || '>' || chr(10) || chr(10) || q.text || coalesce(body, '')) AS rendered FROM q LEFT JOIN b ON q.conv_id = b.conv_id""")
def s6_questions(spark, sf_dir):
    """S6, S8, S9."""
    return scans.questions(threads(spark, sf_dir)).select("query_id", "pos", "url", "title", F.md5(F.col("rendered").cast("binary")).alias("rendered"))


_n = len(scalars.PLACES)


@query("s7_lookups", f"""WITH w AS (SELECT CASE page_id % {_n} WHEN 7 THEN 'stackoverflow' ELSE 'unix' END AS site, page_id AS id FROM pages WHERE page_id % {_n} IN (7, 10) AND page_id % 9 <> 0)
SELECT site, string_agg(id, ';' ORDER BY id) AS ids FROM w GROUP BY site""")
def s7_lookups(spark, sf_dir):
    """Questions that pages link to, in one request for each site; every ninth page's is known."""
    known = table(spark, sf_dir, "pages").where("page_id % 9 = 0").select(F.explode(F.array(F.lit("stackoverflow"), F.lit("unix"))).alias("site"), F.col("page_id").cast("decimal(20,0)").alias("id"))
    return scans.lookups(scalars.links(spark, sf_dir), known)


@query("s0_discovery")
def s0_discovery(spark, sf_dir):
    """Primary and side sources of a query in one pool, entities merged."""
    primary = dedup.entities(scans.hits(scans.metasearch(answers(spark, sf_dir))).drop("engines", "fetch_urls"))
    return primary.select("query_id", "pos", "url", "title", "date", "snippet", F.array_join("urls", " ").alias("keys"))


KINDS = ["Text/HTML; charset=utf-8", None, "application/pdf", "image/png", "text/plain; charset=ISO-8859-1", "text/html", "application/xhtml+xml"]


@query("s12_page_kinds", r"""SELECT page_id, CASE page_id % 7 WHEN 2 THEN 'pdf' WHEN 3 THEN NULL WHEN 4 THEN 'text' ELSE 'html' END AS kind, md5(CASE WHEN page_id % 7 = 4 THEN regexp_replace(html, '[^\x{00}-\x{FF}]', '?', 'g') ELSE html END) AS text FROM pages WHERE strlen(html) <= 5242880""")
def s12_page_kinds(spark, sf_dir):
    """Pages as bytes of several media types: UTF-8, with a byte order mark, or one byte for a character."""
    k = F.col("page_id") % 7
    body = F.when(k == 4, F.encode("html", "ISO-8859-1")).when(k == 5, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    df = table(spark, sf_dir, "pages").select("page_id", scalars.turn(KINDS, k).alias("content_type"), body.alias("body"), "html").where(F.octet_length("html") <= 5 * 1024 * 1024)
    return scans.bounded(df, most=5 * 1024 * 1024 + 3).select("page_id", scans.page_kind(F.col("content_type")).alias("kind"), F.md5(scans.decoded(F.col("body"), F.col("content_type")).cast("binary")).alias("text"))


@query("s16_scripts", r"SELECT page_id, CAST(length(regexp_replace(html, '(?is)<script(>|[/\s][^>]*>).*?(</script[^>]*>|\z)', '', 'g')) AS INT) AS n_chars FROM pages")
def s16_scripts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(scans.without_scripts(F.col("html"))).alias("n_chars"))


#: The article's letters by its marks alone (these references need no semicolon); Markdown's signs and white space do not count.
ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
LETTERS = ARTICLE
for pattern, to in ((r"(?s)<!--.*?-->", ""), ("<[^>]*>", ""), ("&nbsp;", ""), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;", "\'\'"), ("&#39;", "\'\'"), ("&amp;?", "&"), (r"[\s*#`]+", "")):
    LETTERS = f"regexp_replace({LETTERS}, '{pattern}', '{to}', 'g')"


@query("s15_readable", f"SELECT page_id, md5({LETTERS}) AS letters, CAST(length({LETTERS}) AS INT) AS n_letters, false AS shell FROM pages")
def s15_readable(spark, sf_dir):
    """The readable content of pages as Markdown, and whether a page is only a script's frame."""
    found = markdown.extracted(table(spark, sf_dir, "pages"))
    letters = F.regexp_replace("content", r"[\s*#`]+", "")
    return found.select("page_id", F.md5(letters.cast("binary")).alias("letters"), F.length(letters).alias("n_letters"), scans.is_shell(F.col("content")).alias("shell"))


@query("s15_markdown")
def s15_markdown(spark, sf_dir):
    """The Markdown itself."""
    return markdown.extracted(table(spark, sf_dir, "pages"))


@query("c3_resolved", f"""WITH k AS (SELECT page_id, url, CAST(length(regexp_extract(html, '(?s)<article>(.*)</article>', 1)) AS BIGINT) AS n FROM pages)
SELECT page_id AS pos, CASE WHEN n > page_id % 5 * 300 THEN url END AS url, NOT n > page_id % 5 * 300 AS from_snippet, CASE WHEN n > page_id % 5 * 300 THEN n ELSE page_id % 5 * 300 END AS n_chars FROM k""")
def c3_resolved(spark, sf_dir):
    """Candidates take the first page that is longer than their snippet (here the marked article as it stands)."""
    article = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    pages = table(spark, sf_dir, "pages").select("url", article.alias("content"))
    c = table(spark, sf_dir, "pages").select(F.lit(1).alias("query_id"), F.col("page_id").alias("pos"), F.repeat(F.lit("x"), (F.col("page_id") % 5 * 300).cast("int")).alias("snippet"), F.array("url").alias("fetch_urls"))
    return scans.resolved(c, pages).select("pos", "url", "from_snippet", F.length("content").cast("long").alias("n_chars"))


NO_SCRIPTS = r"regexp_replace(html, '(?is)<script(>|[/\s][^>]*>).*?(</script[^>]*>|\z)', '', 'g')"


@query("k2_extractions", f"SELECT sha256(url) AS key, url, CAST(strlen(html) AS INT) AS rawByteLength, CAST(length({NO_SCRIPTS}) AS INT) AS extractedCharLength, CASE WHEN strlen(html) > 0 THEN length({NO_SCRIPTS}) / strlen(html) ELSE 0 END AS ratio FROM pages")
def k2_extractions(spark, sf_dir):
    """K2, K5: diagnostics of extractions (pages without their scripts)."""
    return sinks.extractions(table(spark, sf_dir, "pages").withColumn("markdown", scans.without_scripts(F.col("html")))).drop("html", "markdown")


@query("k3_failures", r"""SELECT sha256(url) AS key, url, CAST(403 + page_id % 2 AS INT) AS status, 'text/html' AS content_type, trim(regexp_replace(substr(html, 1, 2048), '[\x00-\x1f\x7f\s]+', ' ', 'g')) AS preview, 'status' AS error,
  '{"status":502,"body":"{\"error\":\"backend\",\"message\":\"backend error\"}"}' AS answer FROM pages WHERE page_id % 3 = 0""")
def k3_failures(spark, sf_dir):
    """Every third page as one that could not be fetched."""
    k = F.col("page_id")
    fetches = table(spark, sf_dir, "pages").select("url", (403 + k % 2).cast("int").alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"), F.when(k % 3 == 0, "status").alias("error"))
    return sinks.failures(fetches).withColumn("answer", F.to_json(sinks.error(F.lit("backend"), F.col("error"))))


@query("k1_responses")
def k1_responses(spark, sf_dir):
    """The whole search as JSON, one document per query."""
    return search.as_json(search.demo(spark, sf_dir))


# ---- caches and pacing over events
def requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id", (F.col("value") > 20).alias("healthy"))


def recursive(first: str, next_: str) -> str:
    return f"WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT key, tm, n, {first} FROM e WHERE n = 1 UNION ALL SELECT e.key, e.tm, e.n, {next_} FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)"


@query("f1_cache", recursive("tm AS loaded, false AS hit", "CASE WHEN e.tm - r.loaded < 86400 THEN r.loaded ELSE e.tm END, e.tm - r.loaded < 86400") + ' SELECT key, round(tm, 3) AS "at", hit FROM r')
def f1_cache(spark, sf_dir):
    """a day's cache per user, as a fold over each user's requests."""
    return cache.served(requests(spark, sf_dir), "key", "at", 86_400.0).select("key", F.round("at", 3).alias("at"), "hit")


@query("f1_last_healthy", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS tm, value > 20 AS h FROM events) SELECT event_id, CAST(max(CASE WHEN h THEN tm END) OVER (PARTITION BY user_id ORDER BY tm RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS BIGINT) AS stale_at FROM e")
def f1_last_healthy(spark, sf_dir):
    """the last healthy load within an hour (as-of)."""
    e = requests(spark, sf_dir).withColumn("at", F.floor("at"))
    return cache.last_healthy(e, "key", "at", "healthy").select("event_id", "stale_at")


@query("f2_single_flight", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch_us(ts) / 1e6 / 600) AS BIGINT) AS slot, round(min(epoch_us(ts) / 1e6), 3) AS first, count(*) AS waiting FROM events GROUP BY 1, 2")
def f2_single_flight(spark, sf_dir):
    out = cache.single_flight(requests(spark, sf_dir), "key", "at", 600)
    return out.withColumn("first", F.round("first", 3))


@query("f4_retained", f"SELECT event_id FROM (SELECT event_id, ts FROM events WHERE strlen(props) <= {fixed.PAGE_BYTES} ORDER BY ts DESC, event_id DESC LIMIT {fixed.CACHE_ENTRIES})")
def f4_retained(spark, sf_dir):
    """the newest 256 entries that are not too large."""
    e = table(spark, sf_dir, "events").select("event_id", "props", F.struct("ts", "event_id").alias("at"))
    return cache.retained(e, "at", body="props").select("event_id")


@query("f6_pacing", recursive("tm AS started", "greatest(e.tm, r.started + 10)") + " SELECT key, round(tm, 3) AS requested, round(started, 3) AS started FROM r")
def f6_pacing(spark, sf_dir):
    """requests of a user start ten seconds apart."""
    return cache.paced(requests(spark, sf_dir), "key", "at", 10.0).select("key", F.round("requested", 3).alias("requested"), F.round("started", 3).alias("started"))


@query("f7_backoff", "SELECT event_id, coalesce(max(epoch_us(ts) / 1e6 + CASE WHEN value > 90 THEN 3600 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > epoch_us(ts) / 1e6, false) AS blocked FROM events")
def f7_backoff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(F.col("value") > 90, 3600.0).otherwise(0.0).alias("wait"))
    return cache.blocked(e, "user_id", "at", "wait").select("event_id", "blocked")


@query("f_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def f_windows(spark, sf_dir):
    """Hourly windows of event time (the batch form of ``streaming.state.windowed``)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("v3_embeddings")
def v3_embeddings(spark, sf_dir):
    """Prompted texts embedded in batches by the hashing model, 64 dimensions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed.embed(docs, "doc_id", "text", dims=64).select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")), 4).alias("norm"))


@query("e6_health", "SELECT CASE WHEN n > 0 THEN 'ok' ELSE 'unavailable' END AS status, CASE WHEN n > 0 THEN 200 ELSE 503 END AS code, n AS documents FROM (SELECT count(*) AS n FROM documents)")
def e6_health(spark, sf_dir):
    """Can the corpus be read, and is there one?"""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"))
    return n.select(F.when(F.col("documents") > 0, "ok").otherwise("unavailable").alias("status"), F.when(F.col("documents") > 0, 200).otherwise(503).alias("code"), "documents")


@query("s19_pdf", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\x20-\x7e]', '?', 'g')) || chr(10) || chr(10) || url AS content FROM pages")
def s19_pdf(spark, sf_dir):
    """Text of PDF files; the pages' titles and addresses as files of two pages."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url")
    line = lambda c: F.concat(F.lit("BT /F 12 Tf 72 700 Td ("), F.regexp_replace(F.regexp_replace(c, r"[^\x20-\x7e]", "?"), r"([()\\\\])", r"\\$1"), F.lit(") Tj ET"))
    stream = lambda n, c: F.concat(F.lit(f"{n} 0 obj << /Length "), F.octet_length(c).cast("string"), F.lit(" >> stream\n"), c, F.lit("\nendstream endobj\n"))
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R >> endobj\n4 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R >> endobj\n"
    files = p.select("page_id", F.concat(F.lit(head), stream(5, line(F.col("title"))), stream(6, line(F.col("url")))).cast("binary").alias("body"))
    return pdf.extracted(files, "page_id")


#: White space of the reader, as a class for both engines.
BLANK = r"\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query("s19_documents", rf"""SELECT doc_id, length(content) AS n_chars, md5(content) AS digest FROM (
  SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '[{BLANK}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)), '') AS content FROM documents)""")
def s19_documents(spark, sf_dir):
    """Whole texts of documents as pages of 16-bit codes, bare or through two filters by turns, and their text again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shown = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj 0 -12 Td\n")))
    d = d.select("doc_id", F.concat(F.lit("BT /F 10 Tf\n"), F.array_join(shown, ""), F.lit("ET")).alias("content"))  # a column of its own is made once
    content = F.col("content")
    padded = F.rpad(content, (F.ceil(F.length(content) / 128) * 128).cast("int"), F.lit(" "))
    runs = F.regexp_replace(padded, "(?s).{128}", "\x7f$0")  # 127: the next 128 bytes as they are
    turn = F.col("doc_id") % 3
    body = F.when(turn == 0, content).when(turn == 1, runs).otherwise(F.concat(F.hex(runs), F.lit(">")))
    kind = F.when(turn == 0, "").when(turn == 1, "/Filter /RunLengthDecode").otherwise("/Filter [/AHx /RL]")
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F 4 0 R >> >> >> endobj\n4 0 obj << /Type /Font /Subtype /Type0 /Encoding /UniGB-UCS2-H >> endobj\n5 0 obj << "
    d = d.select("doc_id", kind.alias("kind"), body.alias("body"))
    body = F.col("body")
    files = d.select("doc_id", F.concat(F.lit(head), "kind", F.lit(" /Length "), F.length(body).cast("string"), F.lit(" >> stream\n"), body, F.lit("\nendstream endobj\n")).cast("binary").alias("body"))
    return pdf.extracted(files, "doc_id").select("doc_id", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@query("v7_encoder")
def v7_encoder(spark, sf_dir):
    """Items of the benchmark through a small encoder of drawn weights, from mapped files."""
    return embed.embed(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "body"), "item_id", "body", model=encoder.model(encoder.small), dims=16).select("item_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")), 4).alias("norm"))
