"""Queries of the scalar functions over the tables.

The tables' texts are invented words, which no function would tell apart, so rows take turns by their id: some are as they
are, others stand in a question, title or address of a shape that matters, with the row's whole text in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, fixed, intent, text, urls, vectors
from millrace.plans import sql
from millrace.plans.registry import query, table

#: Questions in the shapes that the functions tell apart.
QUESTIONS = [
    (1, "How do I fix error E0502 in Rust borrow checker?"),
    (2, 'tokio "thread panicked cannot start a runtime" workaround'),
    (3, "call serde_json from axum handler"),
    (4, "latest security advisory for openssl 2024"),
    (5, "breaking news about Lisbon on 5 May 2024"),
    (6, "original paper attention is all you need arxiv"),
    (7, "full text of the treaty of Lisbon Article 50"),
    (8, "full-text search index in postgres"),
    (9, "current inflation rate percent in Canada"),
    (10, "USPSTF recommendations on statin use as of March 2023"),
    (11, "coffee near Alexanderplatz"),
    (12, "bazel migration case study"),
    (13, "cpu cuda numerical tolerance drift"),
    (14, "official std::vec documentation"),
    (15, "meta analysis of diabetes medicine"),
    (16, "python AbortSignal.any() request"),
    (17, "who recommends aspirin 2019 study"),
    (18, "weather today"),
    (19, "the"),
    (20, "React useEffect release notes 2023 2023"),
]
#: Every turn of a conversation is a question: by turns as it is, or after one of the questions above.
SHAPES = ["", *(q for _, q in QUESTIONS)]
Q_SQL = f"q AS (SELECT conv_id * 100000 + turn AS query_id, trim({sql.arr(SHAPES)}[(conv_id + turn) % {len(SHAPES)} + 1] || ' ' || coalesce(text, '')) AS query FROM conversations)"
TITLES = [
    (1, "Re: [solved] comment on: Borrowed values", "Borrowed values"),
    (2, "Attention Is All You Need - arXiv", "Attention is all you need"),
    (3, "Release 2024 notes%20for 2024", "release notes for"),
    (4, "A very long title about compilers and", "A very long title about compilers and linkers"),
    (5, "Guide | Example Site", "Other words"),
    (6, "Response to Fwd: the the deep deep learning book", "deep learning book"),
    (7, "https://example.org/a", "x"),
    (8, "How to use parsers — Blog - Site", "parsers"),
]
#: What stands before and after a page's title, and what it is compared with.
DRESSED = [("", ""), ("Re: [solved] comment on: ", ""), ("", " - arXiv"), ("Release 2024 ", "%20for 2024"), ("", " and"), ("", " | Example Site"), ("Response to Fwd: the the ", " book"), ("https://example.org/", ""), ("How to use ", " — Blog - Site"), ("Bazel migration case study: ", "")]
OTHERS = [("", ""), ("", " and linkers"), ("other ", ""), ("", " book")]
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_dress = lambda rows, n: f"{sql.arr(a for a, _ in rows)}[{n} % {len(rows)} + 1] || title || {sql.arr(b for _, b in rows)}[{n} % {len(rows)} + 1]"
T_SQL = f"t AS (SELECT page_id AS id, {_dress(DRESSED, 'page_id')} AS a, {_dress(OTHERS, 'page_id // 2')} AS b FROM (SELECT page_id, {TITLE} AS title FROM pages))"
LINKS = [
    (1, "http://www.example.com/a/?utm_source=x&b=1#frag", None),
    (2, "https://docs.example.co.uk/2024/05/06/post", "2024-03-09T10:00"),
    (3, "ftp://example.com/x", "bad"),
    (4, "https://arxiv.org/abs/1706.03762", "1899-01-01"),
    (5, "https://github.com/Owner/Repo/issues/1", "2026-02-31"),
    (6, "https://docs.rs/crate/serde/latest", None),
    (7, "https://stackoverflow.com/questions/12345/title", None),
    (8, "http://10.0.0.1/admin", None),
    (9, "https://user@example.com/", None),
    (10, "https://unix.stackexchange.com/q/99", None),
    (11, "https://www.cs.school.edu/doi/10.1/x?ref=a&REF=b&c=2&c=3", None),
    (12, "not a url", None),
    (13, "http://100.64.0.9/x", None),
    (14, "https://8.8.8.8/", None),
]
#: Addresses with a page's id in them; the first stands for the page's own address.
PLACES = [("", ""), ("http://www.example.com/a/?utm_source=x&b=", "#frag"), ("https://docs.example.co.uk/2024/05/", "/post"), ("ftp://example.com/", ""), ("https://arxiv.org/abs/1706.0", ""), ("https://github.com/Owner/Repo/issues/", ""), ("https://docs.rs/crate/serde/", ""), ("https://stackoverflow.com/questions/", "/title"), ("http://10.0.0.1/admin", ""), ("https://user@example.com/", ""), ("https://unix.stackexchange.com/q/", ""), ("https://www.cs.school.edu/doi/10.1/x", "?ref=a&REF=b&c=2&c=3"), ("not a url ", ""), ("http://100.64.0.9/x", ""), ("https://8.8.8.8/", "")]
DATES = [None, *(d for _, _, d in LINKS)]
_n = f"page_id % {len(PLACES)}"
L_SQL = f"l AS (SELECT page_id AS id, CASE WHEN {_n} = 0 THEN url ELSE {sql.arr(a for a, _ in PLACES)}[{_n} + 1] || page_id || {sql.arr(b for _, b in PLACES)}[{_n} + 1] END AS url FROM pages)"


def turn(values, at):
    """The literal whose turn it is."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    shape = turn(SHAPES, (F.col("conv_id") + F.col("turn")) % len(SHAPES))
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), F.trim(F.concat(shape, F.lit(" "), F.coalesce("text", F.lit("")))).alias("query"))


def dressed(title, rows, n):
    return F.concat(turn([a for a, _ in rows], n % len(rows)), title, turn([b for _, b in rows], n % len(rows)))


def titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select(F.col("page_id").alias("id"), dressed(F.col("title"), DRESSED, F.col("page_id")).alias("a"), dressed(F.col("title"), OTHERS, F.floor(F.col("page_id") / 2)).alias("b"))


def links(spark, sf_dir):
    n = F.col("page_id") % len(PLACES)
    url = F.when(n == 0, F.col("url")).otherwise(F.concat(turn([a for a, _ in PLACES], n), F.col("page_id").cast("string"), turn([b for _, b in PLACES], n)))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), url.alias("url"), turn(DATES, n).alias("date"))


TOK = sql.tokens("query")


def any_of(values, tokens: str = TOK) -> str:
    return f"list_has_any({tokens}, {sql.arr(values)})"


def pair_of(values) -> str:
    t = TOK
    return f"list_has_any(list_transform(range(1, len({t})), lambda i: ({t})[i] || ' ' || ({t})[i + 1]), {sql.arr(values)})"


FRESH = any_of(fixed.FRESHNESS)


def register(name: str, column, body: str, source: str = "questions", with_sql: str = Q_SQL, key: str = "query_id", relation: str = "q"):
    """A query with a key and one computed column over ``source``."""
    out = name.split("_", 1)[1]

    @query(name, f"WITH {with_sql} SELECT {key}, {body} AS {out} FROM {relation}")
    def run(spark, sf_dir):
        return globals()[source](spark, sf_dir).select(key, column().alias(out))


# ---- text (T) over documents
DOCS = "documents"


@query("t1_term_set", f"SELECT doc_id, CAST(len(list_distinct({sql.tokens('text')})) AS BIGINT) AS n_terms, CAST(len({sql.tokens('text')}) AS BIGINT) AS n_tokens FROM documents")
def t1_term_set(spark, sf_dir):
    """T1, T2."""
    return table(spark, sf_dir, DOCS).select("doc_id", F.size(text.term_set(F.col("text"))).cast("long").alias("n_terms"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    "t3_lexical_terms",
    f"""WITH {Q_SQL}, x AS (SELECT query_id, {TOK} AS t FROM q),
y AS (SELECT query_id, t, generate_subscripts(t, 1) AS i FROM x),
z AS (SELECT *, t[i] AS w, list_contains({sql.arr(fixed.MONTHS)}, t[i]) OR (regexp_full_match(t[i], '[0-9]{{4}}') AND TRY_CAST(t[i] AS INT) BETWEEN 1900 AND 2200) AS dated,
  len(list_filter(range(1, i - 1), lambda s: t[s] = 'as' AND t[s + 1] = 'of' AND len(list_filter(t[s + 2:i], lambda v: v <> 'the' AND NOT list_contains({sql.arr(fixed.MONTHS)}, v) AND NOT regexp_full_match(v, '[0-9]+(st|nd|rd|th)?'))) = 0)) > 0 AS clause FROM y),
k AS (SELECT query_id, w, min(i) AS i FROM z WHERE NOT (dated AND clause) AND strlen(w) >= 3 AND NOT list_contains({sql.arr(fixed.LEXICAL_STOP)}, w) GROUP BY ALL)
SELECT q.query_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM q LEFT JOIN k ON q.query_id = k.query_id GROUP BY q.query_id""",
)
def t3_lexical_terms(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_join(text.lexical_terms(F.col("query")), " ").alias("terms"))


#: Distinct items of a list in the order of their first places.
def once(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query(
    "t4_identifiers",
    rf"""WITH {Q_SQL}, w AS (SELECT query_id, list_filter(list_transform(list_filter({sql.words('query')}, lambda w: NOT contains(w, '://')), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}.:_]+|[^\p{{L}}\p{{N}}.:_]+$', '', 'g')), lambda w: regexp_matches(w, '[.:_]')) AS ws FROM q),
p AS (SELECT query_id, list_transform(ws, lambda w: array_to_string(list_filter(regexp_split_to_array({sql.low('w')}, '[.:_]'), lambda v: v <> ''), '.')) AS ps FROM w),
g AS (SELECT query_id, list_filter(ps, lambda v: contains(v, '.') AND regexp_matches(v, '\p{{L}}') AND NOT list_contains(['com', 'dev', 'io', 'net', 'org'], string_split(v, '.')[-1])) AS ps FROM p)
SELECT query_id, array_to_string({once('ps')}, ' ') AS identifiers FROM g""",
)
def t4_identifiers(spark, sf_dir):
    ids = F.transform(text.identifiers(F.col("query")), lambda p: F.array_join(p, "."))
    return questions(spark, sf_dir).select("query_id", F.array_join(ids, " ").alias("identifiers"))


@query("t5_identifier_match", f"SELECT doc_id, regexp_matches(' ' || array_to_string({sql.tokens('text')}, ' ') || ' ', ' of (of )*the ') AS found FROM documents")
def t5_identifier_match(spark, sf_dir):
    """Does each document contain the words of a compound name in order, with nothing else between?"""
    docs = table(spark, sf_dir, DOCS).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", text.contains_identifier(F.col("t"), F.array(F.lit("of"), F.lit("the"))).alias("found"))


register("t6_years", lambda: F.array_join(text.years(F.col("query")), ","), r"array_to_string(list_filter(list_transform(regexp_extract_all(query, '[0-9]+'), lambda d: TRY_CAST(d AS INT)), lambda y: y BETWEEN 1900 AND 2200), ',')")


@query(
    "t7_title_keys",
    f"""WITH p AS (SELECT page_id, {sql.tokens("replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '%20', ' ')")} AS t FROM pages),
x AS (SELECT page_id, t, generate_subscripts(t, 1) AS i FROM p),
k AS (SELECT page_id, t[i] AS w, min(i) AS i FROM x WHERE NOT (regexp_full_match(t[i], '[0-9]{{4,}}') AND len(list_filter(t, lambda v: v = t[i])) > 1) GROUP BY ALL)
SELECT p.page_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS title_key FROM p LEFT JOIN k ON p.page_id = k.page_id GROUP BY p.page_id""",
)
def t7_title_keys(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.title_key(title).alias("title_key"))


def _equivalent(a: str, b: str) -> str:
    x, y = sql.words(a), sql.words(b)
    short, long = f"CASE WHEN len({x}) <= len({y}) THEN {x} ELSE {y} END", f"CASE WHEN len({x}) <= len({y}) THEN {y} ELSE {x} END"
    return f"({a} = {b} OR (len({short}) >= 4 AND len({short}) * 3 >= len({long}) * 2 AND ({long})[1:len({short})] = ({short})))"


register("t8_title_match", lambda: text.title_keys_equivalent(text.ascii_lower(F.col("a")), text.ascii_lower(F.col("b"))), _equivalent(sql.low("a"), sql.low("b")), "titles", T_SQL, "id", "t")
register("t11_doi", lambda: text.doi(F.concat(F.lit(" doi:https://doi.org/10.1/"), F.col("a"))), f"nullif({sql.low(sql.strip('''regexp_replace(' doi:https://doi.org/10.1/' || a, '^ *(doi:)*(https://doi[.]org/)*(http://doi[.]org/)*', '')'''))}, '')", "titles", T_SQL, "id", "t")


PREFIXES = "|".join(fixed.RESPONSE_PREFIXES)


@query("t12_response_markers", rf"""WITH {T_SQL}, h AS (SELECT id, a, regexp_extract(a, '(?i)^(?:\s*(?:\[[^\]]*\]|{PREFIXES}))*', 0) AS head FROM t)
SELECT id, regexp_matches(regexp_replace(head, '\[[^\]]*\]', '', 'g'), '(?i){PREFIXES}') AS response, regexp_replace(substr(a, length(head) + 1), '^\s+', '') AS subject FROM h""")
def t12_response_markers(spark, sf_dir):
    m = text.response_marker(F.col("a"))
    return titles(spark, sf_dir).select("id", m["response"].alias("response"), m["subject"].alias("subject"))


register("t13_subject_match", lambda: text.subjects_equivalent(text.tokens(F.col("a")), text.tokens(F.col("b"))),
         f"""(len({sql.tokens('a')}) > 0 AND len({sql.tokens('b')}) > 0 AND ({sql.tokens('a')} = {sql.tokens('b')} OR (least(len({sql.tokens('a')}), len({sql.tokens('b')})) >= 4 AND least(len({sql.tokens('a')}), len({sql.tokens('b')})) * 4 >= greatest(len({sql.tokens('a')}), len({sql.tokens('b')})) * 3
AND (starts_with(' ' || array_to_string({sql.tokens('a')}, ' ') || ' ', ' ' || array_to_string({sql.tokens('b')}, ' ') || ' ') OR ends_with(' ' || array_to_string({sql.tokens('a')}, ' ') || ' ', ' ' || array_to_string({sql.tokens('b')}, ' ') || ' ')
OR starts_with(' ' || array_to_string({sql.tokens('b')}, ' ') || ' ', ' ' || array_to_string({sql.tokens('a')}, ' ') || ' ') OR ends_with(' ' || array_to_string({sql.tokens('b')}, ' ') || ' ', ' ' || array_to_string({sql.tokens('a')}, ' ') || ' ')))))""", "titles", T_SQL, "id", "t")  # fmt: skip


_cut = "a"
for _separator in (r" \| ", " — ", " - "):
    _cut = f"regexp_replace({_cut}, '(?s)^(.*){_separator}.*$', '\\1')"


@query("t14_title_subject", rf"""WITH {T_SQL}, c AS (SELECT id, a, {_cut} AS cut FROM t)
SELECT id, CASE WHEN regexp_matches(a, '^[A-Za-z][A-Za-z0-9+.-]*:\S') THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter({sql.tokens('cut')}, lambda w: strlen(w) >= 2 AND NOT list_contains({sql.arr(fixed.TITLE_STOP)}, w)))), ' ') END AS subject FROM c""")
def t14_title_subject(spark, sf_dir):
    return titles(spark, sf_dir).select("id", F.array_join(F.array_sort(text.title_subject(F.col("a"))), " ").alias("subject"))


register("t15_identity_terms", lambda: F.array_join(F.array_sort(text.identity_terms(F.col("query"))), " "), f"array_to_string(list_sort(list_distinct(list_filter({TOK}, lambda w: strlen(w) >= 3 AND NOT list_contains({sql.arr(fixed.IDENTITY_STOP)}, w)))), ' ')")
register("t16_brand_tokens", lambda: F.array_join(F.transform(text.distinctive_tokens(F.col("query")), text.brand), " "),
         f"array_to_string(list_transform(list_filter({TOK}, lambda t: strlen(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({sql.arr(fixed.DISTINCTIVE_STOP)}, t)), lambda t: CASE WHEN strlen(regexp_replace(t, '[0-9]+$', '')) >= 3 THEN regexp_replace(t, '[0-9]+$', '') ELSE t END), ' ')")

#: Passages about a rate, with a number from the document's id and its text after them; the first is the text alone.
RATES = [("", ""), ("The inflation rate in Canada rose to ", "% this year. "), ("Inflation in Canada: prices rose ", " percent over twelve months. "), ("Canada inflation rate ", "% while 250% is no rate. "), ("Canada inflation ", "% rate. "), ("A down payment of 5% at an interest rate of ", "% in Canada. "), ("rate of ", "% somewhere else entirely, of which nobody here has ever heard anything or said anything at all. ")]
RATE_QUESTION = QUESTIONS[8][1]


def facts(spark, sf_dir):
    """(id, host, passage) of documents."""
    n = F.col("doc_id") % len(RATES)
    head = F.when(n == 0, "").otherwise(F.concat(turn([a for a, _ in RATES], n), (F.col("doc_id") % 9).cast("string"), F.lit(".4"), turn([b for _, b in RATES], n)))
    return table(spark, sf_dir, DOCS).select(F.col("doc_id").alias("id"), F.concat(F.lit("www."), F.coalesce("source", F.lit("none")), F.lit(".example-site.org")).alias("host"), F.concat(head, F.coalesce("text", F.lit(""))).alias("passage"), "source")


def stated(spark, sf_dir):
    """(id, source, fact): the percentages of documents that answer the question about a rate."""
    rows = facts(spark, sf_dir).withColumn("c", intent.percent_context(F.lit(RATE_QUESTION)))
    return rows.select("id", "source", F.explode(intent.percentages(F.col("passage"), F.col("c.relations"), F.col("c.topics"))).alias("fact"))


#: What each shape states, by hand: those about the inflation rate of Canada, and no other percentage.
STATED = f"stated AS (SELECT doc_id AS id, source, CAST((doc_id % 9) * 1000 + 400 AS INT) AS fact FROM documents WHERE doc_id % {len(RATES)} BETWEEN 1 AND 5)"


@query("t17_percentage_facts", f"WITH {STATED} SELECT id, fact FROM stated")
def t17_percentage_facts(spark, sf_dir):
    """Percentages of passages that answer a question about a rate."""
    return stated(spark, sf_dir).select("id", "fact")


register("t21_engines", lambda: F.array_join(F.array_sort(text.engines(F.split(F.col("query"), " "))), "|"), rf"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(query, ' '), lambda e: {sql.low('trim(e)')}), lambda e: e <> ''))), '|')")


@query("t20_map_details", """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS house, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS road, CASE WHEN c_custkey % 5 < 2 THEN c_mktsegment ELSE ' ' END AS town,
CASE WHEN c_custkey % 7 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS code, CASE WHEN c_custkey % 4 = 0 THEN n_name END AS land, CASE WHEN c_custkey % 6 = 0 THEN '9-17' END AS hours FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT id, hours, concat_ws(', ', nullif(concat_ws(' ', house, road), ''), nullif(trim(town), ''), code, land) AS place FROM c)
SELECT id, nullif(concat_ws('. ', CASE WHEN place <> '' THEN 'Address: ' || place END, 'Hours: ' || hours), '') AS details FROM w""")
def t20_map_details(spark, sf_dir):
    """Addresses of customers, with parts that some lack."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    address = F.struct(F.when(k % 3 == 0, k.cast("string")).alias("house_number"), F.when(k % 2 == 0, F.col("c_name")).alias("road"), F.when(k % 5 < 2, F.col("c_mktsegment")).otherwise(" ").alias("locality"), F.when(k % 7 == 0, F.col("c_nationkey").cast("string")).alias("postcode"), F.when(k % 4 == 0, F.col("n_name")).alias("country"))
    return c.select(k.alias("id"), text.map_details(address, F.when(k % 6 == 0, "9-17")).alias("details"))


#: Pages with their plain links as Markdown ones; documents after lines in which a title may stand.
LINKED = r"""regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](https://links.example.com\1 "t")', 'g')"""
HEADS = ["", "\n## Only heading here\n", "# Heading\nSubject: A mail\n", "x\n\n  Subject:  \n  #  Late one\n"]


@query("t22_markdown_links", f"WITH m AS (SELECT page_id, {LINKED} AS md FROM pages)" + r", e AS (SELECT page_id, unnest(regexp_extract_all(md, '\[([^\[\]]*)\]\(\s*<?(https?://[^)\s>]*)', 1)) AS label, unnest(regexp_extract_all(md, '\[([^\[\]]*)\]\(\s*<?(https?://[^)\s>]*)', 2)) AS url FROM m) SELECT * FROM e")
def t22_markdown_links(spark, sf_dir):
    md = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', '[$2](https://links.example.com$1 "t")')
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.markdown_links(md)).alias("x")).select("page_id", "x.label", "x.url")


_heads = "[" + ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in HEADS) + "]"


@query("t23_recovered_title", rf"""WITH d AS (SELECT doc_id, string_split({_heads}[doc_id % {len(HEADS)} + 1] || coalesce(text, ''), chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(ls[1:80], lambda x: {sql.strip('x')}), lambda x: regexp_matches(x, '^Subject:\s*\S'))[1] AS subject, list_filter(list_transform(ls[1:20], lambda x: {sql.strip('x')}), lambda x: regexp_matches(x, '^#+\s*\S'))[1] AS heading FROM d),
t AS (SELECT doc_id, coalesce({sql.strip("regexp_replace(subject, '^Subject:', '')")}, {sql.strip("regexp_replace(heading, '^#+', '')")}) AS title FROM f)
SELECT doc_id, CASE WHEN length(title) <= 200 THEN title ELSE 'fallback' END AS title FROM t""")
def t23_recovered_title(spark, sf_dir):
    content = F.concat(turn(HEADS, F.col("doc_id") % len(HEADS)), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, DOCS).select("doc_id", text.recovered_title(content, F.lit("fallback")).alias("title"))


@query("t24_truncate", r"SELECT doc_id, array_to_string(" + sql.words("text") + r", ' ')[1:0] || CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS excerpt, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(substr(text, 1, 99), '\s+$', '') || '…' END AS fitted FROM documents")
def t24_truncate(spark, sf_dir):
    return table(spark, sf_dir, DOCS).select("doc_id", text.truncate(F.col("text"), 80).alias("excerpt"), text.fit(F.col("text"), F.lit(100)).alias("fitted"))


register("t25_retry_after", lambda: text.retry_after(F.concat(F.lit("more requests available in "), F.col("query_id").cast("string"), F.lit(" seconds"))), "CAST(query_id AS BIGINT)")


@query(
    "t26_shingles",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2] || ' ' || t[i+3] || ' ' || t[i+4])) AS s FROM w WHERE len(t) >= 44)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s WHERE len(s) >= 40""",
)
def t26_shingles(spark, sf_dir):
    return table(spark, sf_dir, DOCS).select("doc_id", F.size(text.shingles(F.col("text"))).cast("long").alias("n_shingles")).where("n_shingles > 0")


@query(
    "t27_cache_key",
    rf"""WITH {Q_SQL}, f AS (SELECT query_id, array_to_string({sql.words('query')}, ' ') AS flat FROM q), t AS (SELECT *, list_filter(regexp_split_to_array(flat, '[^\p{{L}}\p{{N}}_:]+'), lambda t: t <> '') AS ts FROM f)
SELECT query_id, CASE WHEN len(list_filter(ts, lambda t: list_contains({sql.arr(i.upper() for i in fixed.ISSUERS)}, t) OR contains(t, '_') OR contains(t, '::') OR (length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 2 AND regexp_matches(t, '[a-z]')))) > 0 THEN flat ELSE {sql.low('flat')} END AS cache_key FROM t""",
)
def t27_cache_key(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", text.cache_key(F.col("query")).alias("cache_key"))


def normal(x: str) -> str:
    """SQL of ``titles.normalized`` (no page title here begins with a tag or a file kind)."""
    low = sql.low(x)
    at = f"list_min(list_filter(list_transform({sql.arr(fixed.TITLE_SITE_SUFFIXES)}, lambda s: instr({low}, s)), lambda p: p > 0))"
    return sql.tokens(f"CASE WHEN {at} IS NULL THEN {x} ELSE substr({x}, 1, {at} - 1) END")


STUDY = "bazel migration case study"
_tail = sql.arr(fixed.TITLE_TAIL)


@query(
    "t9_exact_titles",
    f"""WITH {T_SQL}, n AS (SELECT id, a, {normal("trim(a)")} AS c, {normal("trim(b)")} AS e, {sql.tokens('a')} AS ts FROM t)
SELECT id, array_to_string(c, ' ') AS normalized, e = c OR (len(c) >= 4 AND len(c) < len(e) AND e[1:len(c)] = c AND len(c) * 3 >= len(e) * 2) OR (len(c) > len(e) AND c[1:len(e)] = e AND len(list_filter(c[len(e) + 1:], lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_tail}, w))) = 0) AS equivalent,
  CAST(CASE WHEN (list_has_any(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]), ['case study', 'case studies']) OR (len(list_filter(ts, lambda t: starts_with(t, 'adopt') OR starts_with(t, 'migrat'))) > 0 AND list_has_any(ts, ['experience', 'journey', 'lessons'])))
    AND list_has_any(ts, list_filter({sql.tokens(repr(STUDY))}, lambda w: strlen(w) >= 3 AND NOT list_contains({sql.arr(fixed.IDENTITY_STOP)}, w) AND NOT list_contains({sql.arr(fixed.CASE_STUDY_GENERIC)}, w))) THEN {fixed.CASE_STUDY_WEIGHT} ELSE 0 END AS DOUBLE) AS form FROM n""",
)
def t9_exact_titles(spark, sf_dir):
    """Request and candidate titles."""
    from millrace.functions import titles as f

    return titles(spark, sf_dir).select("id", f.normalized(F.col("a")).alias("normalized"), f.equivalent(F.col("b"), F.col("a")).alias("equivalent"), f.case_study_adjustment(F.lit(STUDY), F.col("a")).alias("form"))


# ---- URLs (U)
CANONICAL = (
    r"""p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
x AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^https?://([^/?]*)', 1)), '^www\.', '') AS h, regexp_extract(u, '^https?://[^/?]*([^?]*)', 1) AS p, string_split(regexp_extract(u, '\?(.*)$', 1), '&') AS q FROM p),
y AS (SELECT page_id, h, CASE WHEN length(p) > 1 THEN coalesce(nullif(regexp_replace(p, '/+$', ''), ''), '/') WHEN p = '' THEN '/' ELSE p END AS p, list_filter(q, lambda v: v <> '' AND NOT starts_with(lower(v), 'utm_') AND NOT list_contains("""
    + sql.arr(fixed.TRACKING)
    + r""", lower(split_part(v, '=', 1)))) AS q FROM x),
k AS (SELECT page_id, 'https://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM y)"""
)


@query("u2_canonical_keys", f"WITH {CANONICAL} SELECT page_id, canonical FROM k")
def u2_canonical_keys(spark, sf_dir):
    """U1, U2."""
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(urls.parse(F.col("url"))).alias("canonical"))


HOST = "lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/?#:]+)', 1))"
REG = f"""CASE WHEN len(string_split({HOST}, '.')) <= 2 THEN {HOST} WHEN list_contains({sql.arr(fixed.MULTI_PART_SUFFIXES)}, array_to_string(string_split({HOST}, '.')[-2:], '.')) THEN array_to_string(string_split({HOST}, '.')[-3:], '.') ELSE array_to_string(string_split({HOST}, '.')[-2:], '.') END"""


@query("u3_registrable_hosts", f"SELECT page_id, {REG} AS site, CASE WHEN starts_with({HOST}, 'docs.') OR starts_with({HOST}, 'doc.') THEN {HOST} ELSE {REG} END AS search_host FROM pages")
def u3_registrable_hosts(spark, sf_dir):
    """U3, U4."""
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.registrable(h).alias("site"), urls.search_host(h).alias("search_host"))


@query("u5_authority_pages", f"SELECT page_id FROM pages WHERE {HOST} = 'example.com' OR ends_with({HOST}, '.example.com')")
def u5_authority_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(urls.belongs(urls.host(F.col("url")), F.lit("example.com"))).select("page_id")


@query("u6_fetch_urls", "SELECT page_id, regexp_replace(url, '#.*$', '') || ' ' || regexp_replace(url, '[?#].*', '') || '.pdf' AS places FROM pages")
def u6_fetch_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    places = urls.fetch_urls(F.col("url"), F.concat(F.col("url"), F.lit("")), F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit(".pdf")))
    return p.select("page_id", F.array_join(places, " ").alias("places"))


WEB = "regexp_matches(url, '^https?://[^/?#\\s]+')"
PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/')"


def below(hosts) -> str:
    return f"len(list_filter({sql.arr(hosts)}, lambda g: h = g OR ends_with(h, '.' || g))) > 0"


@query("u7_scholarly", f"""WITH {L_SQL}, u AS (SELECT id, {HOST} AS h, {PATH} AS p FROM l WHERE {WEB})
SELECT id, h = 'arxiv.org' OR ends_with(h, '.arxiv.org') OR h IN ('doi.org', 'dx.doi.org') OR contains(p, '/doi/') AS record,
  {below(fixed.SCHOLARLY_HOSTS)} OR ends_with(h, '.edu') OR ends_with(h, '.ac.uk') OR list_contains({sql.arr(fixed.RESEARCH_HOSTS)}, h) OR ends_with(h, '.research.google') OR contains(p, '/doi/') AS manifestation, {below(fixed.GENERIC_HOSTS)} AS generic FROM u""")
def u7_scholarly(spark, sf_dir):
    u = F.col("u")
    df = links(spark, sf_dir).withColumn("u", urls.parse(F.col("url"))).where("u is not null")
    return df.select("id", urls.is_scholarly_record(u).alias("record"), urls.is_scholarly_manifestation(u).alias("manifestation"), urls.is_generic(urls.host(u)).alias("generic"))


@query("u8_source_identity", f"""WITH {L_SQL}, u AS (SELECT id, url, {HOST} AS host, regexp_replace({HOST}, '^(www\\.)+', '') AS h, {REG} AS reg, list_filter(string_split({PATH}, '/'), lambda s: s <> '') AS s FROM l WHERE {WEB})
SELECT id, CASE WHEN h IN ('github.com', 'gitlab.com', 'codeberg.org') AND len(s) >= 2 AND lower(s[1]) NOT IN ('orgs', 'search', 'topics', 'users') THEN h || '/' || lower(s[1]) || '/' || lower(s[2])
  WHEN h IN ('docs.rs', 'crates.io', 'lib.rs') AND len(s) >= 1 THEN h || '/' || CASE WHEN lower(s[1]) IN ('crate', 'crates') AND len(s) >= 2 THEN lower(s[2]) ELSE lower(s[1]) END ELSE reg END AS identity,
  CASE WHEN host = 'docs.rs' THEN coalesce(lower(CASE WHEN s[1] = 'crate' THEN s[2] ELSE s[1] END) = 'serde', false) ELSE true END AS in_scope FROM u""")
def u8_source_identity(spark, sf_dir):
    u = F.col("u")
    df = links(spark, sf_dir).withColumn("u", urls.parse(F.col("url"))).where("u is not null")
    return df.select("id", urls.source_identity(u).alias("identity"), urls.docs_scope(F.array(F.lit("serde")), u).alias("in_scope"))


@query("u10_questions", "WITH " + L_SQL + r" SELECT id, CASE WHEN regexp_matches(url, '^https?://(www[.])?stackoverflow[.]com') THEN 'stackoverflow' ELSE regexp_extract(url, '//([a-z]+)[.]stackexchange', 1) END AS site, CAST(regexp_extract(url, '/(?:questions|q)/([0-9]+)', 1) AS BIGINT) AS number FROM l WHERE regexp_matches(url, '^https?://(stackoverflow|[a-z]+[.]stackexchange)[.]com/(questions|q)/[0-9]+')")
def u10_questions(spark, sf_dir):
    df = links(spark, sf_dir).withColumn("q", urls.question(urls.parse(F.col("url")))).where("q is not null")
    return df.select("id", "q.site", F.col("q.id").cast("long").alias("number"))


@query("u11_fetchable", "WITH " + L_SQL + r" SELECT id, regexp_matches(url, '^https?://') AND NOT contains(url, '@') AND NOT regexp_matches(url, '//(10[.]|100[.]64[.])') AS fetchable FROM l")
def u11_fetchable(spark, sf_dir):
    return links(spark, sf_dir).select("id", urls.is_fetchable(F.col("url")).alias("fetchable"))


@query("u13_url_dates", "WITH " + L_SQL + r", m AS (SELECT id, regexp_extract(url, '^https?://[^/]+/(?:.*/)?([12][0-9]{3})/([0-9]{1,2})/([0-9]{1,2})(?:/|$)', ['y', 'm', 'd']) AS x FROM l WHERE regexp_matches(url, '^https?://[a-z]')) SELECT id, CASE WHEN x.y <> '' AND try_cast(x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE) IS NOT NULL THEN try_cast(x.y AS INT) * 372 + (try_cast(x.m AS INT) - 1) * 31 + try_cast(x.d AS INT) - 1 END AS url_date FROM m")
def u13_url_dates(spark, sf_dir):
    return links(spark, sf_dir).where(F.col("url").rlike("^https?://[a-z]")).select("id", dates.url_date_key(urls.path(F.col("url"))).alias("url_date"))


# ---- dates (D)
@query("d1_date_keys", "SELECT o_orderkey, CAST(year(o_orderdate) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1 AS INT) AS date_key FROM orders")
def d1_date_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_key(F.col("o_orderdate").cast("string")).alias("date_key"))


_names, _numbers = sql.arr(fixed.MONTHS), "[" + ", ".join(map(str, fixed.MONTHS.values())) + "]"
_month = lambda x: f"{_numbers}[list_position({_names}, lower({x}))]"
_int = lambda x: f"TRY_CAST({x} AS INT)"
_key = lambda y, m, d: f"CASE WHEN {y} BETWEEN {fixed.FIRST_YEAR} AND {fixed.LAST_YEAR} AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN {y} * 372 + ({m} - 1) * 31 + {d} - 1 END"
_a, _b, _c = "t[i]", "t[i + 1]", "t[i + 2]"
_date = f"""CASE WHEN {_int(_a)} IS NOT NULL AND {_int(_b)} IS NOT NULL AND {_int(_c)} IS NOT NULL AND {_int(_a)} >= {fixed.FIRST_YEAR} THEN {_key(_int(_a), _int(_b), _int(_c))}
  WHEN {_int(_a)} IS NOT NULL AND {_int(_c)} IS NOT NULL THEN {_key(_int(_c), _month(_b), _int(_a))} WHEN {_month(_a)} IS NOT NULL AND {_int(_b)} IS NOT NULL AND {_int(_c)} IS NOT NULL THEN {_key(_int(_c), _month(_a), _int(_b))} END"""
_year = lambda x: f"CASE WHEN {_int(x)} BETWEEN {fixed.FIRST_YEAR} AND {fixed.LAST_YEAR} THEN {_int(x)} END"
_compact = f"TRY_CAST(regexp_extract({_b}, '^[mM]([0-9]{{1,9}})$', 1) AS INT)"
_period = f"coalesce({_year(_a)} * 12 + coalesce({_month(_b)}, CASE WHEN {_compact} BETWEEN 1 AND 12 THEN {_compact} END) - 1, {_year(_b)} * 12 + {_month(_a)} - 1)"


@query("d2_query_dates", rf"""WITH {Q_SQL}, t AS (SELECT query_id, list_filter(regexp_split_to_array(query, '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '') AS t FROM q),
k AS (SELECT query_id, list_filter(list_transform(range(1, len(t) - 1), lambda i: {_date}), lambda v: v IS NOT NULL)[1] AS d, list_filter(list_transform(range(1, len(t)), lambda i: {_period}), lambda v: v IS NOT NULL)[1] AS m FROM t)
SELECT query_id, CAST(d AS INT) AS date_key, CAST(m AS INT) AS month_key, CAST(coalesce(m, 2024 * 12 + 2) AS INT) AS hit_month FROM k""")
def d2_query_dates(spark, sf_dir):
    """D2, D3, D4."""
    return questions(spark, sf_dir).select("query_id", dates.query_date_key(F.col("query")).alias("date_key"), dates.month_key(F.col("query")).alias("month_key"), dates.hit_month_key(F.col("query"), F.lit(""), F.lit("2024-03-09"), F.lit("/")).alias("hit_month"))


@query(
    "d5_staleness",
    """WITH k AS (SELECT o_orderkey, o_custkey, year(o_orderdate) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1 AS k FROM orders),
a AS (SELECT o_orderkey, max(k) OVER (PARTITION BY o_custkey) - k AS age FROM k)
SELECT o_orderkey, CAST(CASE WHEN age <= 31 THEN 0 WHEN age <= 183 THEN -0.015 WHEN age <= 372 THEN -0.03 WHEN age <= 744 THEN -0.06 ELSE -0.10 END AS DOUBLE) AS penalty FROM a""",
)
def d5_staleness(spark, sf_dir):
    """Penalty of each order's age against the customer's newest one."""
    from pyspark.sql import Window

    k = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", dates.date_key(F.col("o_orderdate").cast("string")).alias("k"))
    newest = F.max("k").over(Window.partitionBy("o_custkey"))
    return k.select("o_orderkey", dates.staleness(newest, F.col("k")).alias("penalty"))


@query(
    "d6_period_bonus",
    """WITH k AS (SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS m, CAST(year(o_orderdate) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1 AS INT) AS d FROM orders),
r AS (SELECT o_orderkey, 1996 * 12 - m AS x, abs(1996 * 372 - d) AS y FROM k)
SELECT o_orderkey, CAST(CASE WHEN x = 0 THEN 0.12 WHEN x = 1 THEN 0.08 WHEN x = 2 THEN -0.04 WHEN x >= 3 THEN -0.10 ELSE -0.03 END AS DOUBLE) AS period, CAST(CASE WHEN y = 0 THEN 0.12 WHEN y = 1 THEN 0.04 ELSE 0 END AS DOUBLE) AS exact FROM r""",
)
def d6_period_bonus(spark, sf_dir):
    key = dates.date_key(F.col("o_orderdate").cast("string"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.period_adjustment(F.lit(1996 * 12), month).alias("period"), dates.date_adjustment(F.lit(1996 * 372), key).alias("exact"))


register("d7_year_bonus", lambda: dates.year_adjustment(text.years(F.col("query")), F.lit(2024), F.lit(False), F.lit(False)),
         r"CAST(CASE WHEN list_contains(list_transform(regexp_extract_all(query, '[0-9]+'), lambda d: TRY_CAST(d AS INT)), 2024) THEN 0.03 WHEN len(list_filter(list_transform(regexp_extract_all(query, '[0-9]+'), lambda d: TRY_CAST(d AS INT)), lambda y: y BETWEEN 1900 AND 2022)) > 0 THEN -0.08 ELSE 0 END AS DOUBLE)")

# ---- intent (P)
register("p2_science", lambda: intent.science(F.col("query")), f"({any_of(fixed.EXPLICIT_SCHOLARLY)} OR {pair_of(fixed.SCHOLARLY_PAIRS)} OR {any_of(fixed.DISTINCTIVE_SUBJECTS)} OR ({any_of(fixed.BROAD_SUBJECTS)} AND ({any_of(fixed.SCHOLARLY_WORDS)} OR {any_of(fixed.RESEARCH_CUES)})))")
register("p4_category", lambda: intent.category(F.concat(F.col("query"), F.lit(", it , news")), "it"), "true")
FULL = rf"regexp_matches(' ' || array_to_string({TOK}, ' ') || ' ', ' (fulltext|full text) ') AND NOT regexp_matches(' ' || array_to_string({TOK}, ' ') || ' ', ' (fulltext|full text) ({'|'.join(fixed.FULL_TEXT_FEATURES)}) ')"
register("p13_full_text", lambda: intent.full_text(F.col("query")), f"({FULL})")
STRICT_PHRASE = " OR ".join(f"contains({sql.low('query')}, '{p}')" for p in fixed.STRICT_PHRASES)
register("p5_strict_source", lambda: intent.strict_source(F.col("query")), f"({any_of(['arxiv', 'official'])} OR ({FULL}) OR (list_contains({TOK}, 'original') AND {any_of(['disclosure', 'paper'])}) OR {STRICT_PHRASE})")
register("p10_case_study", lambda: intent.case_study(F.col("query")), f"(contains({sql.low('query')}, 'case study') OR contains({sql.low('query')}, 'case studies'))")
register("p11_numerical_parity", lambda: intent.numerical_parity(F.col("query")), f"list_contains({TOK}, 'cpu') AND list_contains({TOK}, 'cuda') AND {any_of(['drift', 'reproducibility'])} AND {any_of(['numerical', 'tolerance'])}")
register("p12_research", lambda: intent.research(F.col("query")), f"({any_of(fixed.RESEARCH_WORDS)} OR (NOT (contains({sql.low('query')}, 'case study') OR contains({sql.low('query')}, 'case studies')) AND {any_of(['study', 'studies'])}))")
register("p14_as_of", lambda: intent.as_of(F.col("query")), f"({FRESH} OR {pair_of(['as of'])})")
register("p15_recency", lambda: intent.recency(F.col("query")), f"({any_of(fixed.RECENCY)} OR (list_contains({TOK}, 'current') AND {any_of(fixed.TEMPORAL_NOUNS)}))")
register("p16_token", lambda: intent.has_token(F.col("query"), "rust"), f"list_contains({TOK}, 'rust')")
register("p18_shapes", lambda: F.exists(F.transform(text.split_space(F.concat("query", F.lit(" CVE-2024-"), (F.col("query_id") % 20000).cast("string"))), intent.bare), lambda w: intent.is_cve(w) | intent.is_arxiv(w)),
         rf"query_id % 20000 >= 1000 OR len(list_filter(list_transform({sql.words('query')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: regexp_matches(w, '(?i)^cve-[0-9]{{4}}-[0-9]{{4,}}$|^[0-9]{{4}}\.[0-9]{{4,}}$'))) > 0")
register("p19_issuers", lambda: intent.issuer(F.col("query")), f"upper(list_filter({TOK}, lambda t: list_contains({sql.arr(fixed.ISSUERS)}, t))[1])")
register("q23_freshness", lambda: intent.freshness_window(F.col("query")), f"CASE WHEN {FRESH} THEN 'year' END")


_quoted = """regexp_extract_all(query, '"([^"]*)"', 1)"""
_phrase = sql.strip(f"{_quoted}[1]")
_tok = sql.tokens("v")
_contains = lambda x, phrases: "(" + " OR ".join(f"contains({sql.low(x)}, '{p}')" for p in phrases) + ")"
_exact = rf"""(len(list_filter({_quoted}, lambda v: len({_tok}) >= 3 AND (list_has_any({_tok}, {sql.arr(fixed.DIAGNOSTIC_MARKERS)}) OR {_contains('v', fixed.NOT_DIAGNOSTICS)}))) > 0
  OR regexp_matches(' ' || query || ' ', '[^\p{{L}}\p{{N}}](?:{"|".join(fixed.ERROR_CODE_PREFIXES)})[0-9]{{3,5}}[^\p{{L}}\p{{N}}]')
  OR len(list_filter(list_transform({sql.words('query')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}_:]+|[^\p{{L}}\p{{N}}_:]+$', '', 'g')), lambda w: regexp_matches(w, '_|::') AND length(regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 2)) > 0)"""
_cased = r"len(list_filter(regexp_split_to_array(query, '[^\p{L}\p{N}]+'), lambda v: regexp_matches(v, '[a-z]') AND regexp_matches(substr(v, 2), '[A-Z]'))) > 0"


def it_sql(exact: str) -> str:
    """Is a question about information technology, given whether it asks for an exact name?"""
    return f"({exact} OR {any_of(fixed.STRONG_BRANDS)} OR {_contains('query', fixed.BRAND_SPELLINGS)} OR ({any_of(fixed.AMBIGUOUS_BRANDS)} AND ({any_of(fixed.TECHNICAL_CONTEXT)} OR contains(query, '::') OR contains(query, '_') OR {_cased})))"


_it = it_sql(_exact)
_strict = f"({any_of(['arxiv', 'official'])} OR ({FULL}) OR (list_contains({TOK}, 'original') AND {any_of(['disclosure', 'paper'])}) OR {STRICT_PHRASE})"


@query("p1_it_and_news", rf"""WITH {Q_SQL}, i AS (SELECT query_id, query, {_it} AS it FROM q)
SELECT query_id, it, CASE WHEN {any_of(fixed.EXPLICIT_NEWS)} THEN {FRESH} OR NOT it ELSE {FRESH} AND {any_of(fixed.EVENTS)} END AS news,
  coalesce(length({_phrase}) >= 4, false) AND (regexp_matches(' ' || query || ' ', '[^\p{{L}}\p{{N}}][A-Za-z]{{1,4}}[0-9]{{3,5}}[^\p{{L}}\p{{N}}]') OR {any_of(fixed.DIAGNOSTIC_WORDS)}) AS quoted, NOT {_strict} AS auxiliary FROM i""")
def p1_it_and_news(spark, sf_dir):
    """P1, P3, P7, P9."""
    q = F.col("query")
    return questions(spark, sf_dir).select("query_id", intent.it(q).alias("it"), intent.news(q).alias("news"), F.coalesce(intent.has_quoted_diagnostic(q), F.lit(False)).alias("quoted"), intent.auxiliary(q).alias("auxiliary"))


register("p6_documentation", lambda: intent.documentation(F.col("query")), f"list_has_any({TOK}, {sql.arr(fixed.DOCUMENTATION_WORDS)})")


# ---- rewrites (Q)
register("q14_modifiers", lambda: intent.normalized_modifiers(F.col("query")),
         rf"CASE WHEN len(list_filter({sql.words('query')}, lambda w: NOT list_contains({sql.arr(fixed.MODIFIERS)}, {sql.low('''regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')''')}))) = 0 THEN query ELSE array_to_string(list_filter({sql.words('query')}, lambda w: NOT list_contains({sql.arr(fixed.MODIFIERS)}, {sql.low('''regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')''')})), ' ') END")
register("q3_compiler_code", lambda: intent.strict_code(F.col("query")), r"nullif(regexp_extract(' ' || query || ' ', '[^\p{L}\p{N}]((?:E|C|CS|FS|TS|GHC|LNK)[0-9]{3,5})[^\p{L}\p{N}]', 1), '')")
register("q4_loose_code", lambda: intent.loose_code(F.col("query")), r"nullif(regexp_extract(' ' || query || ' ', '[^\p{L}\p{N}]([A-Za-z]{1,4}[0-9]{3,5})[^\p{L}\p{N}]', 1), '')")


# ---- vectors (V)
E = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def register_vector(name: str, column, body: str):
    out = name.split("_", 1)[1]

    @query(name, f"SELECT vec_id, {body} AS {out} FROM embeddings")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "embeddings").select("vec_id", column().alias(out))


ROUND = lambda c: F.transform(c, lambda v: vectors.rounded(v, 6))
register_vector("v6_shortened", lambda: ROUND(vectors.shortened(F.col("embedding"), 16)), f"list_transform({E}[1:16], lambda v: round(v / sqrt(list_inner_product({E}[1:16], {E}[1:16])), 6))")
register_vector("v12_unary", lambda: ROUND(vectors.unary(F.col("embedding"), F.sin)), f"list_transform({E}, lambda v: round(sin(v), 6))")
register_vector("v12_gelu", lambda: ROUND(vectors.unary(F.col("embedding"), vectors.gelu)), f"list_transform({E}, lambda v: round(0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v * v * v))), 6))")
register_vector("v13_binary", lambda: ROUND(vectors.binary(F.transform(F.col("embedding"), lambda v: v.cast("double")), F.array(F.lit(2.5)), lambda a, b: a * b)), f"list_transform({E}, lambda v: round(v * 2.5, 6))")
register_vector("v14_affine", lambda: ROUND(vectors.affine(F.transform(F.col("embedding"), lambda v: v.cast("double")), 3.0, 1.0)), f"list_transform({E}, lambda v: round(v * 3 + 1, 6))")
register_vector("v15_total", lambda: vectors.rounded(vectors.total(F.col("embedding")), 6), f"round(list_sum({E}), 6)")
register_vector("v17_gather", lambda: ROUND(vectors.gather(F.transform(F.col("embedding"), lambda v: v.cast("double")), F.array(F.lit(3), F.lit(0), F.lit(63)))), f"[round({E}[4], 6), round({E}[1], 6), round({E}[64], 6)]")
register_vector("v18_softmax", lambda: ROUND(vectors.softmax(F.col("embedding"))), f"list_transform({E}, lambda v: round(exp(v - list_max({E})) / list_sum(list_transform({E}, lambda u: exp(u - list_max({E})))), 6))")
register_vector("v21_cast", lambda: F.transform(F.col("embedding"), lambda v: (v * F.lit(1000).cast("float")).cast("long")), f"list_transform(embedding, lambda v: CAST(trunc(CAST(v AS FLOAT) * CAST(1000 AS FLOAT)) AS BIGINT))")
register_vector("v22_narrow", lambda: ROUND(vectors.narrow(F.transform(F.col("embedding"), lambda v: v.cast("double")), 8, 4)), f"list_transform({E}[9:12], lambda v: round(v, 6))")


@query("v9_rotary_and_norm")
def v9_rotary_and_norm(spark, sf_dir):
    """Rotation and root-mean-square scaling of each vector."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    angles = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.pow(F.lit(10000.0), -i / 32.0))
    rotated = vectors.rotary(x, F.transform(angles, F.cos), F.transform(angles, F.sin))
    return table(spark, sf_dir, "embeddings").select("vec_id", ROUND(rotated).alias("rotated"), ROUND(vectors.rms_norm(x, F.transform(x, lambda _: F.lit(0.0)))).alias("scaled"))


@query(
    "v16_gram",
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT label, j, sum(v) AS v FROM e GROUP BY ALL)
SELECT a.label AS i, b.label AS k, round(sum(a.v * b.v), 4) AS product FROM s a JOIN s b ON a.j = b.j GROUP BY ALL""",
)
def v16_gram(spark, sf_dir):
    """Product of the matrix of label sums with its transpose, as a join on the inner index."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("j", "v")).groupBy("label", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    a, b = e.toDF("i", "j", "x"), e.toDF("k", "j", "y")
    return a.join(b, "j").groupBy("i", "k").agg(F.round(F.sum(F.col("x") * F.col("y")), 4).alias("product"))
