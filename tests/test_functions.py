"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, intent, text, titles, urls


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("query", "terms"),
    [
        ("Guidance as of the 5th of May 2023 on Statins", ["guidance", "5th", "2023", "statins"]),
        ("status as of May 2024 for foo", ["status", "foo"]),
        ("The the data", []),
    ],
)
def test_lexical_terms(value, query, terms):
    got = value(text.lexical_terms(F.lit(query)))
    assert [t for t in got if t not in ("may",)] == [t for t in terms if t not in ("may",)]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com/a/?utm_source=x&b=1#f", "https://example.com/a?b=1"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8080/x//", "https://example.com:8080/x"),
        ("http://example.com:80/x", "https://example.com/x"),
        ("https://example.com/?REF=1&UTM_x=2", "https://example.com/"),
        ("ftp://example.com/", None),
        ("no url", None),
    ],
)
def test_canonical(value, url, key):
    assert value(urls.canonical(urls.parse(F.lit(url)))) == key


@pytest.mark.parametrize(("host", "site"), [("a.b.example.com", "example.com"), ("x.example.co.uk", "example.co.uk"), ("example.com", "example.com"), ("localhost", "localhost")])
def test_registrable(value, host, site):
    assert value(urls.registrable(F.lit(host))) == site


@pytest.mark.parametrize(("address", "public"), [("8.8.8.8", True), ("10.1.1.1", False), ("172.16.0.1", False), ("192.0.2.1", False), ("256.1.1.1", False), ("100.64.0.1", False), ("224.0.0.1", False)])
def test_public_addresses(value, address, public):
    assert value(urls.is_public_ipv4(F.lit(address))) is public


def test_date_keys(value):
    assert value(dates.date_key(F.lit("2026-02-31"))) == 2026 * 372 + 31 + 30
    assert value(dates.date_key(F.lit("1899-01-01"))) is None
    assert value(dates.date_key(F.lit("2024"))) is None
    assert value(dates.month_key(F.lit("CPI 2024 M05"))) == 2024 * 12 + 4
    assert value(dates.query_date_key(F.lit("on 5 May 2024 and"))) == 2024 * 372 + 4 * 31 + 4
    assert value(dates.url_date_key(F.lit("/a/2024/05/06/x"))) == 2024 * 372 + 4 * 31 + 5


@pytest.mark.parametrize(("age", "penalty"), [(31, 0.0), (32, -0.015), (184, -0.03), (373, -0.06), (745, -0.10)])
def test_staleness(value, age, penalty):
    assert value(dates.staleness(F.lit(1000), F.lit(1000 - age))) == penalty


@pytest.mark.parametrize(
    ("query", "exact"),
    [
        ('tokio "thread panicked cannot start a runtime" workaround', '"thread panicked cannot start a runtime" tokio'),
        ("error E0502 in rust vector", '"E0502" rust vector'),
        ("call foo_bar from numpy", '"foo_bar" numpy'),
        ("std::vec docs", '"std::vec"'),
        ("plain words", None),
    ],
)
def test_exact_identifier(value, query, exact):
    assert value(intent.exact_identifier(F.lit(query))) == exact


def test_titles(value):
    assert value(titles.equivalent(F.lit("Attention is all you need"), F.lit("[PDF] Attention Is All You Need - arXiv")))
    assert value(titles.equivalent(F.lit("one two three four five six"), F.lit("One Two Three Four")))
    assert not value(titles.equivalent(F.lit("one two three"), F.lit("one two four")))
    assert value(titles.requested(F.lit("full text of the treaty of Lisbon"))) == "the treaty of Lisbon"
    assert value(text.title_keys_equivalent(F.lit("a b c d"), F.lit("a b c d e")))
    assert not value(text.title_keys_equivalent(F.lit("a b c"), F.lit("a b c d")))


def test_identifier_matching(value):
    parts = F.array(F.lit("abortsignal"), F.lit("any"))
    assert value(text.contains_identifier(text.tokens(F.lit("see AbortSignal (#abortsignal) any")), parts))
    assert not value(text.contains_identifier(text.tokens(F.lit("an AbortSignal that any")), parts))


def test_fit(value):
    assert [value(text.fit(F.lit("ab cd"), F.lit(n))) for n in (0, 1, 4, 5)] == ["", "…", "ab…", "ab cd"]


def test_cache_key(value):
    assert value(text.cache_key(F.lit("  Hello   World "))) == "hello world"
    assert value(text.cache_key(F.lit("WHO advice"))) == "WHO advice"
    assert value(text.cache_key(F.lit("JavaScript tips"))) == "JavaScript tips"


def test_null_inputs(value):
    none = F.lit(None).cast("string")
    for f in (text.tokens, text.lexical_terms, text.title_key, text.doi, urls.canonical, dates.date_key, intent.it):
        value(f(none))


@pytest.mark.parametrize(
    ("query", "host"),
    [
        ("Next.js routing", "nextjs.org"),
        ('postgres "relation does not exist" error', "postgresql.org"),
        ("postgres tuning", None),
        ("official python docs", "docs.python.org"),
        ("federal funds rate history", "federalreserve.gov"),
        ("RFC 9110 caching", "rfc-editor.org"),
        ("nasa and fda", "nasa.gov"),
        ("WHO advice", "who.int"),
        ("who wrote it", None),
        ("world health organisation report", "who.int"),
    ],
)
def test_named_sites(value, query, host):
    from millrace.operators import planner

    assert value(planner.authority_host(F.lit(query))) == host


def test_projects_and_sources(value):
    from millrace.operators import rank
    from millrace.sources import scans

    scope = lambda q, u: value(rank.project_scope(F.lit(q), F.lit(u)))
    assert scope("tokio docs", "https://github.com/tokio-rs/tokio") == 0.10
    assert scope("tokio docs", "https://docs.rs/tokio/latest") == 0.12
    assert scope("tokio docs", "https://docs.rs/crate/serde/1") == -0.18
    assert scope("tokio", "https://docs.rs/serde/1") == 0.0
    assert scope("serde_json error", "https://github.com/serde-rs/json") == 0.08
    assert value(scans.printer_url(F.lit("https://unix.stackexchange.com/q/9"))).count("service=unix.stackexchange&") == 1
    assert value(intent.paper_title(F.lit("latest arxiv paper on big models"))) is None
    assert value(intent.asks_questions(F.lit("tokio panic"))) and not value(intent.asks_questions(F.lit("tokio tutorial")))
