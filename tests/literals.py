"""Literal rows of the shapes that functions tell apart, and the functions over them."""

import json

from pyspark.sql import functions as F

from millrace.functions import intent, text, titles
from millrace.operators import dedup, evidence, rank
from millrace.plans import registry, scalars
from millrace.sources import scans, sinks

TITLES = scalars.TITLES
LINKS = scalars.LINKS
FACTS = [
    (1, "a.example.com", "The inflation rate in Canada rose to 3.4% this year."),
    (2, "b.example.org", "Inflation in Canada: prices rose 3.4 percent over twelve months."),
    (3, "c.example.net", "Canada inflation rate 3.4% while 250% is no rate"),
    (4, "www.c.example.net", "Canada inflation 2.9% rate"),
    (5, "d.example.net", "A down payment of 5% at an interest rate of 6.1% in Canada"),
    (6, "e.example.net", "Nothing about numbers here"),
    (7, "f.example.net", "rate of 7% somewhere else entirely"),
]
ANSWER = json.dumps(
    {
        "results": [
            {"url": "https://www.example.com/a?utm_source=x", "title": "First page", "content": "A snippet", "publishedDate": "2024-05-06T01:02", "score": 1.5, "engines": ["One", "two "]},
            {"url": "https://example.com/a", "title": "First page again", "score": 2.5, "engines": ["three"], "links": [{"label": "Official website", "url": "https://official.example.org/"}]},
            {"url": "https://example.net/p", "title": "A paper about things", "doi": "doi:10.1/X", "pdf_url": "https://example.net/p.pdf", "html_url": "https://example.net/p.html", "score": 2.5, "engines": ["a", "b"]},
            {"url": "ftp://no", "title": "bad"},
            {"url": "https://map.example.org/x", "links": {"site": "https://x.example.org"}, "address": {"road": "Main Road", "locality": "Town"}, "data": [{"key": "Opening hours", "value": "9-17"}], "unknown": 1},
        ],
        "unresponsive_engines": [["slow", "timeout"]],
    }
)
ISSUE = json.dumps({"items": [{"title": "Crash", "html_url": "https://github.com/o/r/issues/1", "created_at": "2024-01-02T03:04:05Z", "body": "x" * 900}, {"title": "bad", "html_url": "nope"}]})
QUESTION = json.dumps(
    {
        "items": [
            {
                "question_id": 7,
                "title": "Why &lt;b&gt;?",
                "body_markdown": "Because",
                "link": "https://stackoverflow.com/q/7",
                "score": 3,
                "tags": ["x", "y"],
                "is_answered": True,
                "owner": {"display_name": "A]B"},
                "answers": [{"answer_id": 1, "body_markdown": "low", "score": 1}, {"answer_id": 2, "body_markdown": "ok", "score": 0, "is_accepted": True}],
            }
        ]
    }
)
MARKDOWN = [(1, "See [the docs](https://docs.example.com/a \"t\") and [x](<http://x.org>) or [no](ftp://x) plain"), (2, "# Heading\nSubject: A mail\ntext"), (3, "\n## Only heading\n"), (4, "nothing")]
ADVICE = [
    (1, "USPSTF 2023 statement. Adults should start a statin. Other text.", "statin", ["uspstf"], 2023),
    (2, "The Preventive Services Task Force in 2023: statin use; they must wait", "statin", ["uspstf"], 2023),
    (3, "In 2023 the preventive services task force: consider statin use", "statin", ["uspstf"], 2023),
    (4, "USPSTF 2022: consider statin use", "statin", ["uspstf"], 2023),
    (5, "Consider statin use", "statin", [], None),
]


def given(spark, monkeypatch):
    """The registered queries over the literal questions, titles and links."""
    monkeypatch.setattr(scalars, "questions", lambda s, _: s.createDataFrame(scalars.QUESTIONS, "query_id int, query string"))
    monkeypatch.setattr(scalars, "titles", lambda s, _: s.createDataFrame(TITLES, "id int, a string, b string"))
    monkeypatch.setattr(scalars, "links", lambda s, _: s.createDataFrame(LINKS, "id int, url string, date string"))


def registered(name):
    def run(spark, monkeypatch):
        given(spark, monkeypatch)
        return registry.queries()[name](spark, None)

    return run


def answers(spark, body):
    return spark.createDataFrame([(1, body)], "query_id long, body string")


def map_details(spark, _):
    rows = [(1, "5", "Main Road", "Town", None, "Land", "9-17"), (2, None, None, None, None, None, "9-17"), (3, None, "Road", None, "123", None, None), (4, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, house_number string, road string, locality string, postcode string, country string, hours string")
    return df.select("id", text.map_details(F.struct("house_number", "road", "locality", "postcode", "country"), F.col("hours")).alias("details"))


def facts(spark, _):
    rows = spark.createDataFrame(FACTS, "id int, host string, passage string").withColumn("c", intent.percent_context(F.lit(scalars.RATE_QUESTION)))
    return rows.select("id", F.array_join(intent.percentages(F.col("passage"), F.col("c.relations"), F.col("c.topics")), ",").alias("facts"))


def kinds(spark, _):
    rows = [(1, "Text/HTML; charset=utf-8", b"a"), (2, None, "é".encode()), (3, "application/pdf", b"%PDF"), (4, "image/png", b""), (5, "text/plain; charset=ISO-8859-1", b"\xe9"), (6, "text/html", b"\xef\xbb\xbfx"), (7, "text/html", b"\xe9t\xe9")]
    df = spark.createDataFrame(rows, "id int, content_type string, body binary")
    return scans.bounded(df).select("id", scans.page_kind(F.col("content_type")).alias("kind"), scans.decoded(F.col("body"), F.col("content_type")).alias("text"))


def failures(spark, _):
    rows = [("https://a.example/", 403, "text/html", "a\x00b\n\n c", "status"), ("https://b.example/", 200, "text/html", "x", None)]
    out = sinks.failures(spark.createDataFrame(rows, "url string, status int, content_type string, body string, error string"))
    return out.withColumn("answer", F.to_json(sinks.error(F.lit("backend"), F.col("error"))))


def lookups(spark, _):
    wanted = spark.createDataFrame([(f"https://stackoverflow.com/questions/{i}/t",) for i in (9, 7, 12, 7)] + [("https://unix.stackexchange.com/q/3",), ("https://example.com/",)], "url string")
    cached = spark.createDataFrame([("stackoverflow", "9")], "site string, id string").withColumn("id", F.col("id").cast("decimal(20,0)"))
    return scans.lookups(wanted, cached)


def discovery(spark, _):
    primary = dedup.entities(scans.hits(scans.metasearch(answers(spark, ANSWER))).drop("engines", "fetch_urls"))
    return primary.select("query_id", "pos", "url", "title", "date", "snippet", F.array_join("urls", " ").alias("keys"))


def candidates(spark, _):
    rows = [
        (1, "https://www.example.gov/canada/inflation", "Inflation in Canada", "The rate in May 2024", "2024-05-20", 0.5, 0.8, 0.0, None),
        (2, "https://blog.example.com/2020/01/02/x", "Old post", "inflation 2020", None, 0.6, 0.4, 0.0, None),
        (3, "https://stats.example.org/cpi", "CPI", "", "2024-05-01", 0.4, 0.9, 1.0, "example.org"),
    ]
    df = spark.createDataFrame(rows, "id int, url string, title string, snippet string, date string, dense double, evidence double, recommendation double, named string")
    return df.select("id", F.round(rank.candidate_score(F.lit("current inflation rate Canada May 2024"), F.lit(2024 * 372 + 4 * 31 + 19)), 6).alias("score"))


def replies(spark, _):
    rows = [(1, "a.org", "Slow parser in release builds", False), (2, "a.org", "Re: Slow parser in release builds", True), (3, "b.org", "Re: Slow parser in release builds", True), (4, "a.org", "Comment on: parser in release builds", True), (5, "a.org", "Other", False)]
    return dedup.reply_roots(spark.createDataFrame(rows, "doc_id int, host string, title string, source_priority boolean"))


def advice(spark, _):
    df = spark.createDataFrame(ADVICE, "id int, passage string, term string, acronyms array<string>, year int")
    return df.select("id", evidence.recommends(F.col("passage"), F.col("term"), F.col("acronyms"), F.col("year")).alias("score"))


def exact_titles(spark, _):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(TITLES, "id int, a string, b string")
    return df.select("id", titles.normalized(a).alias("normalized"), titles.equivalent(b, a).alias("equivalent"), titles.case_study_adjustment(F.lit("bazel migration case study"), a).alias("form"))


def search_urls(spark, _):
    none = F.lit(None).cast("string")
    q = spark.createDataFrame(scalars.QUESTIONS, "query_id int, query string")
    return q.select("query_id", scans.search_url("http://search.example", F.col("query"), F.when(F.col("query_id") % 2 == 0, "it"), none, F.when(F.col("query_id") == 4, "year")).alias("url"))


CASES = {n: registered(n) for n in ("d2_query_dates", "p1_it_and_news", "p8_reservations", "q1_rewrites", "q6_plans", "t12_response_markers", "t14_title_subject", "t27_cache_key", "t4_identifiers", "u7_scholarly", "u8_source_identity")}
CASES |= {
    "a3_recommendations": advice,
    "j4_replies": replies,
    "k3_failures": failures,
    "s0_discovery": discovery,
    "s12_page_kinds": kinds,
    "s1_metasearch": lambda s, _: scans.hits(scans.metasearch(answers(s, ANSWER))).select("query_id", "pos", "url", "title", "date", "snippet", "doi", F.array_join("fetch_urls", " ").alias("places")),
    "s3_search_urls": search_urls,
    "s5_issues": lambda s, _: scans.issues(answers(s, ISSUE)),
    "s6_questions": lambda s, _: scans.questions(answers(s, QUESTION)),
    "s7_lookups": lookups,
    "t17_percentage_facts": facts,
    "t20_map_details": map_details,
    "t23_recovered_title": lambda s, _: s.createDataFrame(MARKDOWN, "id int, md string").select("id", text.recovered_title(F.col("md"), F.lit("fallback")).alias("title")),
    "t9_exact_titles": exact_titles,
    "w1_candidate_scores": candidates,
}
