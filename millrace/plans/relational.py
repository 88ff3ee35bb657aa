"""Queries of joins, merges, aggregates, ranks, duplicates, passages and budgets, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import fixed, sentences, text, urls, vectors
from millrace.operators import budget, chunking, dedup, dense, evidence, follow, merge, rank
from millrace.plans import sql
from millrace.plans.registry import query, table
from millrace.plans.scalars import CANONICAL, HOST, REG, STATED, TITLE, WEB, stated, turn

#: Questions in the words of the test documents.
LOOKUPS = [(1, "hewh and onon hahehe outionre"), (2, "queque de aiauxvi elle tion"), (3, "keit ung enheit der lichkeit nicht")]
K_SQL = sql.values("k", ["query_id", "query"], LOOKUPS)


def lookups(spark):
    return spark.createDataFrame(LOOKUPS, "query_id int, query string")


TERMS = f"""{K_SQL},
qt AS (SELECT query_id, t, i FROM (SELECT query_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT query_id, {sql.tokens('query')} AS t FROM k)) WHERE strlen(t) >= 3 AND NOT list_contains({sql.arr(fixed.LEXICAL_STOP)}, t)),
term AS (SELECT query_id, t, min(i) AS i FROM qt GROUP BY ALL),
dt AS (SELECT doc_id, unnest(list_distinct({sql.tokens('text')})) AS t FROM documents),
hit AS (SELECT doc_id, t FROM dt WHERE t IN (SELECT t FROM term)),
df AS (SELECT t, count(*) AS df FROM hit GROUP BY t),
w AS (SELECT query_id, term.t, i, coalesce(df, 0) AS df, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) + 1 AS w FROM term LEFT JOIN df ON term.t = df.t),
wd AS (SELECT *, df > 0 AND row_number() OVER (PARTITION BY query_id ORDER BY (df > 0) DESC, w DESC, i) <= 2 AS d FROM w)"""
SCORE = f"""{TERMS},
tot AS (SELECT query_id, sum(w) AS w, sum(w) FILTER (WHERE d) AS wd FROM wd GROUP BY query_id),
got AS (SELECT query_id, doc_id, sum(w) AS g, coalesce(sum(w) FILTER (WHERE d), 0) AS gd FROM hit JOIN wd ON hit.t = wd.t GROUP BY ALL),
score AS (SELECT got.query_id, doc_id, CASE WHEN tot.wd IS NULL THEN g / tot.w ELSE 0.6 * g / tot.w + 0.4 * gd / tot.wd END AS s FROM got JOIN tot ON got.query_id = tot.query_id)"""


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = evidence.query_terms(lookups(spark))
    hits = evidence.matches(docs, terms)
    weighted = evidence.weights(terms, hits, docs.count())
    return weighted, evidence.coverage(weighted, hits)


@query("a1_term_weights", f"WITH {TERMS} SELECT query_id, t AS term, CAST(df AS BIGINT) AS df, round(w, 9) AS weight, d AS decisive FROM wd")
def a1_term_weights(spark, sf_dir):
    return scored(spark, sf_dir)[0].select("query_id", "term", "df", F.round("weight", 9).alias("weight"), "decisive")


@query("a2_coverage", f"WITH {SCORE} SELECT query_id, doc_id, round(s, 9) AS score FROM score")
def a2_coverage(spark, sf_dir):
    """A2, J8, J9."""
    return scored(spark, sf_dir)[1].select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query("o2_lexical_top", f"WITH {SCORE} SELECT query_id, doc_id, round(s, 9) AS score, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM score) WHERE r <= 32")
def o2_lexical_top(spark, sf_dir):
    """O2, O3: the candidate pool."""
    s = scored(spark, sf_dir)[1].withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= fixed.POOL)


#: Statements before the documents' texts: named or not, of the year or not, with an action and the term in one sentence or not.
ADVICE = ["", "USPSTF 2023 statement. Adults should start a statin. ", "The Preventive Services Task Force in 2023: statin use; they must wait. ", "In 2023 the preventive services task force: consider statin use. ", "USPSTF 2022: consider statin use. ", "Consider statin use. "]
_p = f"{sql.arr(ADVICE)}[doc_id % {len(ADVICE)} + 1] || coalesce(text, '')"


@query("a3_recommendations", rf"""WITH p AS (SELECT doc_id, {_p} AS p FROM documents), t AS (SELECT doc_id, p, {sql.tokens('p')} AS ts FROM p)
SELECT doc_id, CAST((list_contains(ts, 'uspstf') OR list_has_all(ts, {sql.arr(fixed.ISSUERS['uspstf'])})) AND list_contains(list_transform(regexp_extract_all(p, '[0-9]+'), lambda d: TRY_CAST(d AS INT)), 2023)
  AND len(list_filter(regexp_split_to_array(p, '[.!?\n;]'), lambda s: list_contains({sql.tokens('s')}, 'statin') AND list_has_any({sql.tokens('s')}, {sql.arr(fixed.ACTIONS)}))) > 0 AS DOUBLE) AS score FROM t""")
def a3_recommendations(spark, sf_dir):
    """A3: the best sentence of every document, for a term, an issuer and a year."""
    passage = F.concat(turn(ADVICE, F.col("doc_id") % len(ADVICE)), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.recommends(passage, F.lit("statin"), text.words_of(["uspstf"]), F.lit(2023)).alias("score"))


_cut = "coalesce(text, '')"
for _pattern, _to in sentences.RULES:
    _cut = f"""regexp_replace({_cut}, '{_pattern.replace("'", "''")}', {" || ".join(f"'{chr(92)}{x}'" if x.isdigit() else f"chr({ord(x)})" for x in _to)}, 'g')"""
SENTENCES = f"list_filter(list_transform(string_split(replace({_cut}, chr(2), '.'), chr(1)), lambda s: regexp_replace(s, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda s: s <> '')"


@query("a3_sentences", f"SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def a3_sentences(spark, sf_dir):
    """A3: the sentences of all documents."""
    s = table(spark, sf_dir, "documents").select("doc_id", sentences.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("digest"))


@query("a3_best_sentences", f"""WITH {K_SQL}, s AS (SELECT doc_id, {SENTENCES} AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM s),
c AS (SELECT query_id, doc_id, sentence, i, len(list_intersect({sql.tokens('sentence')}, {sql.tokens('query')})) AS n FROM e, k)
SELECT query_id, doc_id, sentence, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n DESC, i) AS r FROM c WHERE n > 0) WHERE r = 1""")
def a3_best_sentences(spark, sf_dir):
    """A3, A10: of every document with a word of a question, the sentence with the most of them, the first on ties."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences.sentences(F.col("text"))).alias("i", "sentence")).withColumn("ts", text.term_set(F.col("sentence")))
    each = F.array(*[F.struct(F.lit(q).alias("query_id"), F.size(F.array_intersect("ts", text.words_of(sorted(set(w.lower() for w in words.split()))))).alias("n")) for q, words in LOOKUPS])
    best = found.select("doc_id", "i", "sentence", F.explode(each).alias("x")).where("x.n > 0").groupBy(F.col("x.query_id").alias("query_id"), "doc_id").agg(F.max_by(F.struct("sentence", "x.n"), F.struct("x.n", -F.col("i"))).alias("b"))
    return best.select("query_id", "doc_id", "b.sentence", "b.n")


@query("a4_added_terms", f"WITH d AS (SELECT doc_id, substr(text, 1, 60) AS e, substr(text, 61) AS c FROM documents) SELECT doc_id, len(list_filter(list_distinct({sql.tokens('e')}), lambda t: list_contains(['the', 'and', 'thanea', 'que', 'der'], t) AND NOT list_contains({sql.tokens('c')}, t))) > 0 AS adds FROM d")
def a4_added_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("e"), F.expr("substring(text, 61)").alias("c"))
    return d.select("doc_id", evidence.adds_terms(F.col("e"), F.col("c"), text.words_of(["the", "and", "thanea", "que", "der"])).alias("adds"))


@query("a5_numeric_consensus", f"""WITH {STATED}, s AS (SELECT fact, count(DISTINCT source) AS n FROM stated GROUP BY fact HAVING count(DISTINCT source) >= {fixed.NUMERIC_DOMAINS})
SELECT id AS doc_id, max(CAST({fixed.NUMERIC_WEIGHT} * n / (SELECT max(n) FROM s) AS DOUBLE)) AS score FROM stated JOIN s ON stated.fact = s.fact GROUP BY id""")
def a5_numeric_consensus(spark, sf_dir):
    """Percentages that three sites or more agree on."""
    found = stated(spark, sf_dir).select(F.lit(1).alias("query_id"), F.col("id").alias("doc_id"), F.col("source").alias("site"), "fact")
    return evidence.numeric_consensus(found).select("doc_id", "score")


@query("a7_consensus", "WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS n FROM events GROUP BY ALL) SELECT user_id AS hit, bool_or(n >= 2) AS consensus FROM o GROUP BY user_id")
def a7_consensus(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return dedup.consensus(e.select(F.col("user_id").alias("hit"), F.to_date("ts").alias("observation"), F.col("event_type").alias("engine")))


@query("a8_flag_merge", f"SELECT {REG} AS site, bool_or(starts_with(url, 'https')) AS secure, max(substr(url, 1, 10)) AS newest, min_by(url, page_id) FILTER (WHERE url LIKE '%/en/%') AS first_english, count(DISTINCT {HOST}) AS hosts FROM pages GROUP BY 1")
def a8_flag_merge(spark, sf_dir):
    """Flags or-ed, largest string, first value that fits, over the pages of a site."""
    p = table(spark, sf_dir, "pages").withColumn("h", urls.host(F.col("url")))
    english = F.min_by("url", F.when(F.col("url").contains("/en/"), F.col("page_id")))
    return p.groupBy(urls.registrable(F.col("h")).alias("site")).agg(F.max(F.col("url").startswith("https").cast("int")).cast("boolean").alias("secure"), F.max(F.substring("url", 1, 10)).alias("newest"), F.when(F.max(F.col("url").contains("/en/").cast("int")) == 1, english).alias("first_english"), F.countDistinct("h").alias("hosts"))


_host = f"regexp_replace({HOST}, '^www\\.', '')"
_labels = r"list_transform(string_split(host, '.'), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')))"
_inst = "(ends_with(host, '.gov') OR ends_with(host, '.edu') OR ends_with(host, '.int') OR ends_with(host, '.ac.uk'))"
_telling = f"list_filter({sql.tokens('query')}, lambda t: strlen(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({sql.arr(fixed.DISTINCTIVE_STOP)}, t))"
_brand = "CASE WHEN strlen(regexp_replace(t, '[0-9]+$', '')) >= 3 THEN regexp_replace(t, '[0-9]+$', '') ELSE t END"
_docs = "(starts_with(host, 'doc.') OR starts_with(host, 'docs.') OR host = 'docs.rs' OR ends_with(host, '.readthedocs.io'))"
_parts = f"list_transform(string_split(path, '/'), lambda t: {_brand})"


@query("a9_official_host", rf"""WITH p AS (SELECT page_id // 12 AS query_id, page_id % 12 AS pos, url, {_host} AS host, {TITLE} AS title, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages WHERE {WEB}),
q AS (SELECT query_id, min_by('official ' || string_split(host, '.')[-3] || ' ' || title, pos) AS query FROM p GROUP BY query_id),
t AS (SELECT query_id, {_telling} AS tokens, list_transform({_telling}, lambda t: {_brand}) AS brands, list_has_any({sql.tokens('query')}, ['election', 'voter', 'voting']) AND list_has_any({sql.tokens('query')}, ['deadline', 'registration']) AS public FROM q),
r AS (SELECT p.query_id, pos, host, public, list_has_any({_labels}, brands) AS brand, {_docs} AND list_has_any({_parts}, brands) AS identity, {_inst} AS inst, least(2, len(list_filter(tokens, lambda t: contains({sql.low('title')}, t)))) AS matches, pos % 3 AS n
  FROM p JOIN t ON p.query_id = t.query_id WHERE len(list_filter({sql.arr(fixed.GENERIC_HOSTS)}, lambda g: host = g OR ends_with(host, '.' || g))) = 0),
s AS (SELECT *, 4 * brand::INT + 3 * identity::INT + 2 * inst::INT + matches + n AS score FROM r WHERE CASE WHEN public THEN ends_with(host, '.gov') AND matches >= 1 ELSE ((brand OR identity) AND matches >= 1) OR (inst AND matches >= 2) END),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k FROM s), u AS (SELECT query_id, score, 'https://' || host || '/' AS url FROM b WHERE k = 1)
SELECT query_id, CASE WHEN starts_with({HOST}, 'docs.') OR starts_with({HOST}, 'doc.') THEN {HOST} ELSE {REG} END AS host, CAST(score AS INT) AS score FROM u""")
def a9_official_host(spark, sf_dir):
    """The likely official site of every twelve pages, for a question with the first one's name and title."""
    key = [F.floor(F.col("page_id") / 12).alias("query_id"), (F.col("page_id") % 12).alias("pos")]
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    engines = F.slice(text.words_of(["one", "two"]), 1, (F.col("page_id") % 12 % 3).cast("int"))
    r = table(spark, sf_dir, "pages").select(*key, "url", title.alias("title"), engines.alias("engines"))
    named = F.concat(F.lit("official "), F.element_at(F.split(F.regexp_replace(urls.host(urls.parse(F.col("url"))), r"^www\.", ""), "[.]"), -3), F.lit(" "), F.col("title"))
    return rank.infer_official_host(r.groupBy("query_id").agg(F.min_by(named, "pos").alias("query")), r).select("query_id", "host", F.col("score").cast("int").alias("score"))


# ---- merges (M) and joins (J) over documents, as two ranked lists (by the last digit of the source) of a query for each two hundred of them
_list = lambda even: f"SELECT doc_id // 200 AS query_id, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) - 1 AS pos, 'u' || (doc_id % 97) AS url, doc_id FROM documents WHERE {'' if even else 'NOT '}regexp_matches(coalesce(source, ''), '[02468]$')"
LISTS = f"a AS ({_list(True)}), b AS ({_list(False)})"


def lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("query_id", F.floor(F.col("doc_id") / 200))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")) - 1
    even = F.coalesce("source", F.lit("")).rlike("[02468]$")

    def one(mine):
        return docs.where(mine).select("query_id", pos.alias("pos"), F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("url"), "doc_id")

    return one(even), one(~even)


def merged_sql(body: str) -> str:
    return f"WITH {LISTS}, m AS ({body}) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, y, z) - 1 AS INT) AS pos, url, doc_id FROM m"


@query("m1_interleave", merged_sql("SELECT *, pos AS x, 0 AS y, 0 AS z FROM a UNION ALL SELECT *, pos, 1, 0 FROM b"))
def m1_interleave(spark, sf_dir):
    """M1, M2."""
    return merge.interleave(*lists(spark, sf_dir))


@query("m3_source_merge", f"WITH {LISTS}, f AS (SELECT *, 0 AS s FROM b WHERE doc_id % 2 = 0 UNION ALL SELECT *, 1 FROM a WHERE doc_id % 2 = 0), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, pos) AS x, 0 AS y FROM f UNION ALL SELECT *, 0, row_number() OVER (PARTITION BY query_id ORDER BY pos), 1 FROM a WHERE doc_id % 2 = 1) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, y) - 1 AS INT) AS pos, url, doc_id FROM l")
def m3_source_merge(spark, sf_dir):
    a, b = lists(spark, sf_dir)
    return merge.source_merge(a, b, F.col("doc_id") % 2 == 0)


@query("m4_local_merge", merged_sql(f"SELECT *, 1 AS x, pos AS y, 0 AS z FROM a UNION ALL SELECT *, CASE WHEN pos < {fixed.SIDE_POSITION} THEN 0 ELSE 2 END, pos, 0 FROM b"))
def m4_local_merge(spark, sf_dir):
    return merge.local_merge(*lists(spark, sf_dir))


@query("m5_manifestations", f"""WITH {LISTS}, c AS (SELECT *, doc_id % 6 AS cov, max(doc_id % 6) OVER (PARTITION BY query_id) AS best, 4 * (doc_id % 2 = 0)::INT + 2 * (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS form FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY form DESC, pos) - 1 AS n FROM c WHERE cov = best),
m AS (SELECT query_id, url, doc_id, n AS x, 0 AS y FROM k WHERE n < CASE WHEN cov >= 4 AND cov * 3 >= 12 THEN 4 ELSE 1 END UNION ALL SELECT query_id, url, doc_id, pos, 1 FROM a)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, y) - 1 AS INT) AS pos, url, doc_id FROM m""")
def m5_manifestations(spark, sf_dir):
    a, b = lists(spark, sf_dir)
    d = F.col("doc_id")
    found = b.withColumn("coverage", (d % 6).cast("int")).withColumn("terms", F.lit(6)).withColumn("pdf", d % 2 == 0).withColumn("html", d % 3 == 0).withColumn("doi", d % 5 == 0)
    return merge.manifestation_merge(a, found)


#: Side rows whose address and title are new to their query, after the first primary ones.
SIDE = f"""s AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY pos) AS u FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.url = b.url)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id % 13 ORDER BY pos) AS n FROM s WHERE u = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = s.query_id AND a.doc_id % 13 = s.doc_id % 13)),
m AS (SELECT query_id, pos, url, doc_id, CASE WHEN pos < {fixed.SIDE_POSITION} THEN 0 ELSE 2 END AS x FROM a UNION ALL SELECT query_id, pos, url, doc_id, 1 FROM t WHERE n = 1),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY x, pos) - 1 AS pos, url, doc_id FROM m)"""


@query("m6_pool", f"""WITH {LISTS}, {SIDE} SELECT query_id, CAST(pos AS INT) AS pos, url, doc_id, true AS healthy FROM r WHERE pos < 20 AND query_id % 7 <> 3 AND query_id IN (SELECT query_id FROM a)
UNION ALL SELECT query_id, CAST(pos AS INT), url, doc_id, false FROM b WHERE pos < 20 AND (query_id % 7 = 3 OR query_id NOT IN (SELECT query_id FROM a))""")
def m6_pool(spark, sf_dir):
    """M6: a query whose primary scan failed has side rows only and is not healthy."""
    a, b = (x.withColumn("url_key", F.col("url")).withColumn("title_key", F.col("doc_id") % 13) for x in lists(spark, sf_dir))
    healthy = a.select("query_id").distinct().withColumn("healthy", F.col("query_id") % 7 != 3)
    return merge.pool(a, b, healthy, 20).select("query_id", "pos", "url", "doc_id", "healthy")


@query("m7_backfill", f"WITH {LISTS}, m AS (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY s, pos) AS n FROM m) WHERE n = 1), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s, pos) - 1 AS pos, url, doc_id FROM o) SELECT query_id, CAST(pos AS INT) AS pos, url, doc_id FROM r WHERE pos < 32")
def m7_backfill(spark, sf_dir):
    return merge.backfill(*lists(spark, sf_dir), fixed.POOL)


@query("m8_prioritize", f"WITH {LISTS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 3 = 0 DESC, pos) - 1 AS INT) AS pos, url, doc_id FROM a")
def m8_prioritize(spark, sf_dir):
    return merge.prioritize(lists(spark, sf_dir)[0], F.col("doc_id") % 3 == 0)


@query("m9_reserve", f"WITH {LISTS}, s AS (SELECT *, doc_id % 4 = 0 AS p, doc_id % 7 AS sc FROM a), f AS (SELECT *, p AND row_number() OVER (PARTITION BY query_id ORDER BY p DESC, sc DESC, pos) = 1 AS f FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, pos) - 1 AS n FROM f) SELECT query_id, CAST(n AS INT) AS pos, doc_id FROM r WHERE n < 8")
def m9_reserve(spark, sf_dir):
    a = lists(spark, sf_dir)[0].withColumn("p", F.col("doc_id") % 4 == 0).withColumn("score", F.col("doc_id") % 7)
    return merge.reserve(a, "p", "score", 8).select("query_id", "pos", "doc_id")


@query("o1_relevance_sort", f"WITH {LISTS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 5 DESC, doc_id % 3 DESC, pos) - 1 AS INT) AS pos, doc_id FROM a")
def o1_relevance_sort(spark, sf_dir):
    a = lists(spark, sf_dir)[0].withColumn("score", F.col("doc_id") % 5).withColumn("n_engines", F.col("doc_id") % 3)
    return merge.relevance_sorted(a).select("query_id", "pos", "doc_id")


@query("j1_reattach", f"WITH {LISTS} SELECT a.query_id, a.doc_id, coalesce(b.n > 0, false) AS known, coalesce(b.n, 0) AS n FROM a LEFT JOIN (SELECT query_id, url, count(*) AS n FROM b GROUP BY ALL) b ON a.query_id = b.query_id AND a.url = b.url")
def j1_reattach(spark, sf_dir):
    """Rows find their metadata again by URL; defaults where there is none."""
    a, b = lists(spark, sf_dir)
    meta = b.groupBy("query_id", "url").agg(F.count(F.lit(1)).alias("n"))
    return a.join(meta, ["query_id", "url"], "left").select("query_id", "doc_id", F.coalesce(F.col("n") > 0, F.lit(False)).alias("known"), F.coalesce("n", F.lit(0)).alias("n"))


_equal = "(len(x) > 0 AND len(y) > 0 AND (x = y OR (least(len(x), len(y)) >= 4 AND least(len(x), len(y)) * 4 >= greatest(len(x), len(y)) * 3 AND CASE WHEN len(x) < len(y) THEN y[1:len(x)] = x OR y[len(y) - len(x) + 1:] = x ELSE x[1:len(y)] = y OR x[len(x) - len(y) + 1:] = y END)))"


@query("j4_replies", f"""WITH p AS (SELECT page_id, {HOST} AS host, {TITLE} AS title FROM pages), r AS (SELECT page_id // 3 AS g, host, title FROM p WHERE page_id % 3 = 0),
d AS (SELECT page_id, CASE WHEN page_id % 3 = 2 THEN p.host ELSE r.host END AS host, r.title, page_id % 3 = 0 AS root, {sql.tokens("CASE WHEN page_id % 3 = 0 THEN r.title WHEN page_id % 6 = 1 THEN r.title || ' again' ELSE r.title END")} AS w FROM p JOIN r ON p.page_id // 3 = r.g)
SELECT root, reply FROM (SELECT a.page_id AS root, b.page_id AS reply, a.w AS x, b.w AS y FROM d a JOIN d b ON a.host = b.host AND a.root AND NOT b.root) WHERE {_equal}""")
def j4_replies(spark, sf_dir):
    """Pages and replies to every third of them, on its own host or another, some with one more word."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("own"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    n = F.col("page_id") % 3
    g = F.floor(F.col("page_id") / 3).alias("g")
    roots = p.where(n == 0).select(g, F.col("own").alias("there"), F.col("title").alias("first"))
    both = p.withColumn("g", F.floor(F.col("page_id") / 3)).join(roots, "g")
    title = F.when(n == 0, F.col("first")).otherwise(F.concat(F.lit("Re: "), F.col("first"), F.when(F.col("page_id") % 6 == 1, " again").otherwise("")))
    return dedup.reply_roots(both.select(F.col("page_id").alias("doc_id"), F.when(n == 2, F.col("own")).otherwise(F.col("there")).alias("host"), title.alias("title"), (n > 0).alias("source_priority")))


@query("j5_unlabelled", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j5_unlabelled(spark, sf_dir):
    """Anti join."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("j6_side_insert", f"WITH {LISTS}, {SIDE} SELECT query_id, CAST(pos AS INT) AS pos, url, doc_id FROM r WHERE pos < {fixed.POOL}")
def j6_side_insert(spark, sf_dir):
    a, b = (x.withColumn("url_key", F.col("url")).withColumn("title_key", F.col("doc_id") % 13) for x in lists(spark, sf_dir))
    return merge.side_insert(a, b, fixed.POOL).select("query_id", "pos", "url", "doc_id")


@query("j10_trusted", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def j10_trusted(spark, sf_dir):
    """Semi join."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


# ---- duplicates
PAIRS = r"""w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM documents),
s AS (SELECT doc_id, source, list_distinct(list_transform(range(1, len(t) - 3), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2] || ' ' || t[i+3] || ' ' || t[i+4])) AS s FROM w WHERE len(t) >= 44),
k AS (SELECT doc_id, source, len(s) AS n, s FROM s WHERE len(s) >= 40),
e AS (SELECT doc_id, source, n, unnest(s) AS g FROM k),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, least(x.n, y.n) AS small, greatest(x.n, y.n) AS large, x.source = y.source AS same FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n, x.source, y.source),
p AS (SELECT a, b, shared, small, large FROM j WHERE (same AND shared * 100 >= small * 95 AND shared * 100 >= large * 82) OR (shared * 100 >= small * 98 AND shared * 100 >= large * 95))"""


@query("j3_near_pairs", f"WITH {PAIRS} SELECT a, b, CAST(shared AS INT) AS shared, CAST(small AS INT) AS small, CAST(large AS INT) AS large FROM p")
def j3_near_pairs(spark, sf_dir):
    """J3, T26."""
    return dedup.near_pairs(table(spark, sf_dir, "documents"), "source")


@query("c2_clusters", f"WITH RECURSIVE {PAIRS}, l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id) SELECT id AS doc_id, min(m) AS cluster FROM r GROUP BY id")
def c2_clusters(spark, sf_dir):
    """C1, C2."""
    docs = table(spark, sf_dir, "documents")
    return dedup.clusters(docs, dedup.near_links(docs, "source"))


@query("a11_representatives", f"WITH RECURSIVE {PAIRS}, l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id), c AS (SELECT id AS doc_id, min(m) AS cluster FROM r GROUP BY id) SELECT cluster AS position, arg_min(c.doc_id, (-n_chars, c.doc_id)) AS doc_id, bool_or(c.doc_id % 5 = 0) AS source_priority FROM c JOIN documents d ON c.doc_id = d.doc_id GROUP BY cluster")
def a11_representatives(spark, sf_dir):
    """The longest document of each cluster, flags or-ed, at the cluster's first place."""
    docs = table(spark, sf_dir, "documents")
    members = dedup.clusters(docs, dedup.near_links(docs, "source")).join(docs.select("doc_id", "n_chars"), "doc_id").withColumn("source_priority", F.col("doc_id") % 5 == 0)
    return dedup.representatives(members, [F.desc("n_chars")]).select("position", "doc_id", "source_priority")


@query("j7_exact_groups", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def j7_exact_groups(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("u2_pages_once", f"WITH {CANONICAL} SELECT min(page_id) AS page_id, count(*) AS copies FROM k GROUP BY canonical")
def u2_pages_once(spark, sf_dir):
    """Pages once per canonical URL."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.canonical(urls.parse(F.col("url"))).alias("key"))
    return p.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies")).drop("key")


# ---- vectors and ranks
@query("v1_dense_top", "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_inner_product(list_transform(e, lambda v: CAST(v AS DOUBLE)), list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS score FROM q, embeddings WHERE query_id <> vec_id) SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place = 1")
def v1_dense_top(spark, sf_dir):
    """V1: the nearest vector of every row whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    return dense.nearest(e.where("vec_id % 50 = 0"), e, 1).drop("place")


@query("v1_dense_search", "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_inner_product(list_transform(e, lambda v: CAST(v AS DOUBLE)), list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS score FROM q, embeddings WHERE query_id <> vec_id) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS place FROM s) WHERE place <= 10")
def v1_dense_search(spark, sf_dir):
    """V1: ten nearest vectors of every row whose id is divisible by 50, in blocks of queries."""
    e = table(spark, sf_dir, "embeddings")
    return dense.nearest(e.where("vec_id % 50 = 0"), e, 10)


HYBRID = f"WITH {SCORE}, h AS (SELECT score.query_id, score.doc_id, round(list_inner_product(list_transform(q.embedding, lambda v: CAST(v AS DOUBLE)), list_transform(e.embedding, lambda v: CAST(v AS DOUBLE))) + 0.1 * s, 6) AS score, score.doc_id % 11 = 0 AS p, score.doc_id % 3 = 0 AS c FROM score JOIN embeddings e ON score.doc_id = e.vec_id JOIN embeddings q ON q.vec_id = score.query_id)"


def hybrid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id between 1 and 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    s = scored(spark, sf_dir)[1].withColumnRenamed("score", "s").join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(q, "query_id")
    return s.select("query_id", "doc_id", F.round(vectors.dot(F.col("q"), F.col("embedding")) + fixed.LEXICAL_WEIGHT * F.col("s"), 6).alias("score"), (F.col("doc_id") % 11 == 0).alias("source_priority"), (F.col("doc_id") % 3 == 0).alias("upstream_consensus"))


@query("w8_hybrid_scores", f"{HYBRID} SELECT query_id, doc_id, score FROM h")
def w8_hybrid_scores(spark, sf_dir):
    """Dense score and a tenth of the evidence."""
    return hybrid(spark, sf_dir).select("query_id", "doc_id", "score")


@query("w3_shortlist", f"""{HYBRID}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS pos FROM h),
a AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rk, p AND row_number() OVER (PARTITION BY query_id ORDER BY p DESC, score DESC, pos) = 1 AS f FROM n),
b AS (SELECT *, CASE WHEN f THEN 0 WHEN c AND pos < ceil((8 - max(CAST(f AS INT)) OVER (PARTITION BY query_id)) / 2) AND best - score <= 0.1 THEN 1 ELSE 2 END AS rule FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rule, CASE WHEN rule = 1 THEN pos ELSE rk END) - 1 AS sel FROM b) SELECT query_id, doc_id, CAST(sel AS INT) AS selected FROM r WHERE sel < 8""")  # fmt: skip
def w3_shortlist(spark, sf_dir):
    h = hybrid(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")) - 1)
    return rank.shortlist(h, 8).select("query_id", "doc_id", "selected")


CHUNKS = r"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE doc_id < 300),
c AS (SELECT doc_id, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448) AS BIGINT) + 1 END)) AS ordinal, w FROM words)"""


@query("x1_chunks", CHUNKS.replace(" WHERE doc_id < 300", "").join(["WITH ", " SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(least(512, len(w) - ordinal * 448) AS INT) AS tokens, md5(array_to_string(w[ordinal * 448 + 1:ordinal * 448 + 512], ' ')) AS digest FROM c"]))
def x1_chunks(spark, sf_dir):
    """Windows of 512 words with 64 in common."""
    c = chunking.chunks(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "ordinal", "tokens", F.md5(text.collapse(F.col("text")).cast("binary")).alias("digest"))


@query("x4_merged_ranges", """WITH r AS (SELECT l_orderkey AS k, epoch(l_shipdate) // 86400 AS s, epoch(l_shipdate) // 86400 + CAST(l_quantity AS BIGINT) AS e, l_linenumber AS p FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT k AS l_orderkey, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", min(p) AS priority FROM i GROUP BY k, isl""")
def x4_merged_ranges(spark, sf_dir):
    """An order's shipping intervals, merged where they overlap or touch."""
    day = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").alias("priority"))
    return chunking.merged(r, "l_orderkey")


SOLID = r"[\p{L}\p{M}\p{N}]"


@query("x3_passages", rf"""WITH d AS (SELECT doc_id, text, length(text) AS n, length(text) > 200 AND regexp_matches(text[81:200], '[^ \t\n\x0B\f\r]') AS two FROM documents WHERE text <> ''),
r AS (SELECT *, CASE WHEN n > 200 AND NOT two THEN 260 ELSE 80 END AS stop FROM d),
b AS (SELECT doc_id, unnest(CASE WHEN two THEN [{{'a': 200, 'b': least(n, 260)}}, {{'a': 0, 'b': least(n, stop)}}] ELSE [{{'a': 0, 'b': least(n, stop)}}] END) AS s, two, n, text FROM r),
c AS (SELECT *, text[s.a + 1:s.b] AS raw, s.a > 0 AND regexp_matches(text[s.a:s.a], '{SOLID}') AND regexp_matches(text[s.a + 1:s.a + 1], '{SOLID}') AS l, regexp_matches(text[s.b:s.b], '{SOLID}') AND regexp_matches(text[s.b + 1:s.b + 1], '{SOLID}') AS e FROM b),
x AS (SELECT *, CASE WHEN l THEN regexp_replace(raw, '^{SOLID}+', '') ELSE raw END AS x FROM c),
y AS (SELECT *, {sql.strip("CASE WHEN e THEN regexp_replace(x, '" + SOLID + "+$', '') ELSE x END")} AS y FROM x),
p AS (SELECT doc_id, any_value(text) AS text, bool_or(two) AS two, max(s.b) AS last, string_agg(CASE WHEN y = '' THEN {sql.strip("raw")} ELSE y END, chr(10) || chr(10) || '…' || chr(10) || chr(10) ORDER BY s.a DESC) AS body FROM y GROUP BY doc_id)
SELECT doc_id, body || CASE WHEN regexp_matches(text[last + 1:], '[^ \t\n\x0B\f\r]') THEN chr(10) || chr(10) || '…' ELSE '' END AS passage, two OR regexp_matches(text[last + 1:], '[^ \t\n\x0B\f\r]') AS truncated FROM p""")
def x3_passages(spark, sf_dir):
    """Three spans of each document (two overlap) assembled into a passage."""
    docs = table(spark, sf_dir, "documents")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("priority")) for a, b, p in ((0, 40, 2), (30, 80, 1), (200, 260, 0))])
    ranges = docs.select("doc_id", F.length("text").alias("n"), F.explode(spans).alias("s")).select("doc_id", "s.start", F.least("s.end", "n").alias("end"), "s.priority").where(F.col("start") < F.col("end"))
    return chunking.assembled(ranges, docs)


SCORED_CHUNKS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT doc_id, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 100 THEN 1 ELSE CAST(ceil((len(w) - 100) / 80) AS BIGINT) + 1 END)) AS o, w FROM w),
s AS (SELECT doc_id // 50 AS query_id, doc_id, CAST(o AS INT) AS ordinal, round((CAST('0x' || substr(md5(array_to_string(w[o * 80 + 1:o * 80 + 100], ' ')), 1, 5) AS INT) % 1000) / 1000, 3) AS score FROM c)"""


def chunk_scores(spark, sf_dir):
    """Chunks of 100 words with scores that their words determine, as candidates of a query for each fifty documents."""
    c = chunking.chunks(table(spark, sf_dir, "documents"), 100, 20)
    number = F.conv(F.substring(F.md5(text.collapse(F.col("text")).cast("binary")), 1, 5), 16, 10).cast("int")
    return c.select(F.floor(F.col("doc_id") / 50).alias("query_id"), "doc_id", "ordinal", F.round((number % 1000) / 1000, 3).alias("score"))


@query("w7_best_chunks", f"""WITH {SCORED_CHUNKS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, ordinal) AS own FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own > 1, score DESC, doc_id, ordinal) - 1 AS selected FROM r WHERE own <= {fixed.CHUNKS_PER_DOCUMENT})
SELECT query_id, doc_id, ordinal, score, CAST(selected AS INT) AS selected FROM t WHERE selected < {fixed.CHUNKS_TOTAL}""")
def w7_best_chunks(spark, sf_dir):
    """The best chunk of every document first, then others by score, 24 of a query."""
    return rank.best_chunks(chunk_scores(spark, sf_dir))


@query("w7_chunk_selection")
def w7_chunk_selection(spark, sf_dir):
    """The choice itself; documents with a seed take neighbouring chunks only."""
    s = chunk_scores(spark, sf_dir).withColumn("seed", F.col("score") > 0.97)
    return rank.adjacent_chunks(s)


@query("w4_chunk_cap", f"""WITH {SCORED_CHUNKS},
a AS (SELECT doc_id, ordinal, CASE WHEN score > 0.5 THEN score ELSE 0 END AS lexical, score > 0.97 AS seed, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
seeds AS (SELECT doc_id, i AS j, row_number() OVER (PARTITION BY doc_id ORDER BY lexical DESC, i) AS rank FROM a WHERE seed QUALIFY rank <= {fixed.CHUNKS_SCORED // 2}),
near AS (SELECT doc_id, i, min({{'distance': abs(i - j), 'rank': rank, 'front': i < j}}) AS near FROM a JOIN seeds USING (doc_id) GROUP BY ALL),
named AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY near, lexical DESC, i) AS first FROM a LEFT JOIN near USING (doc_id, i) WHERE near IS NOT NULL OR lexical > 0 QUALIFY first <= {fixed.CHUNKS_SCORED // 2}),
l AS (SELECT doc_id, {fixed.CHUNKS_SCORED} - count(*) AS rest FROM named GROUP BY doc_id),
spread AS (SELECT DISTINCT doc_id, k * (n - 1) // (rest - 1) AS i FROM (SELECT doc_id, n, coalesce(rest, {fixed.CHUNKS_SCORED}) AS rest, unnest(range(coalesce(rest, {fixed.CHUNKS_SCORED}))) AS k FROM (SELECT DISTINCT doc_id, n FROM a) LEFT JOIN l USING (doc_id))),
placed AS (SELECT a.*, row_number() OVER (PARTITION BY a.doc_id ORDER BY CASE WHEN named.i IS NOT NULL THEN 0 WHEN spread.i IS NOT NULL THEN 1 ELSE 2 END, a.i) AS place FROM a LEFT JOIN named USING (doc_id, i) LEFT JOIN spread USING (doc_id, i))
SELECT doc_id, ordinal, lexical, seed FROM placed WHERE n <= {fixed.CHUNKS_SCORED} OR place <= {fixed.CHUNKS_SCORED}""")
def w4_chunk_cap(spark, sf_dir):
    """Eight chunks of each document."""
    s = chunk_scores(spark, sf_dir).select("doc_id", "ordinal", F.when(F.col("score") > 0.5, F.col("score")).otherwise(0.0).alias("lexical"), (F.col("score") > 0.97).alias("seed"))
    return chunking.capped(s)


@query("w5_documents")
def w5_documents(spark, sf_dir):
    """Eight documents of each query's pool (the best ``POOL`` hits), diversified by source and subject."""
    h = hybrid(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("n") <= fixed.POOL).drop("n")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.term_set(F.col("text")).alias("subject"))
    h = h.join(docs, "doc_id").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")) - 1)
    h = h.withColumn("exact", F.lit(False)).withColumn("is_anchor", F.lit(False))
    return rank.documents(h.select("query_id", "pos", "doc_id", "score", "source_priority", "upstream_consensus", "exact", "is_anchor", "source", "subject"), 8).drop("subject")


FLAT = sql.low("array_to_string(" + sql.words("{}") + ", ' ')")


@query("w9_excerpts", f"WITH d AS (SELECT doc_id, split_part(text, '.', 1) AS e, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'other' END AS c FROM documents) SELECT doc_id, CASE WHEN regexp_replace(e, '\\s', '', 'g') <> '' AND NOT contains({FLAT.format('c')}, {FLAT.format('e')}) THEN 'Search excerpt: ' || e END AS excerpt FROM d")
def w9_excerpts(spark, sf_dir):
    """The first sentence as an excerpt, of the document itself and of another one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("e"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("other").alias("c"))
    return d.select("doc_id", rank.useful_excerpt(F.col("e"), F.col("c"), F.lit(True)).alias("excerpt"))


@query("a6_topped_up", f"""WITH {SCORED_CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, ordinal) AS n FROM s)
SELECT query_id, doc_id, ordinal, round(CASE WHEN n = 1 THEN score + ({fixed.GAP} * greatest(0.0, 0.9 - score) + 0.05) ELSE score END, 6) AS score FROM r""")
def a6_topped_up(spark, sf_dir):
    s = chunk_scores(spark, sf_dir).withColumn("excerpt_score", F.lit(0.9)).withColumn("consensus", F.lit(0.0)).withColumn("document_consensus", F.lit(0.05))
    return rank.topped_up(s).select("query_id", "doc_id", "ordinal", F.round("score", 6).alias("score"))


BUDGET = 3000


SHARES = f"""WITH r AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) > 0),
k AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS c, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n, turn)),
s AS (SELECT *, min(CASE WHEN n <= ({BUDGET} - b) // (c - k) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n, turn ROWS UNBOUNDED PRECEDING) AS whole FROM k),
l AS (SELECT *, {BUDGET} - coalesce(sum(n) FILTER (WHERE whole = 1) OVER (PARTITION BY conv_id), 0) AS left_over, count(*) FILTER (WHERE whole = 0) OVER (PARTITION BY conv_id) AS cut, row_number() OVER (PARTITION BY conv_id, whole ORDER BY turn) - 1 AS i FROM s)"""
SHARE = "CAST(CASE WHEN whole = 1 THEN n ELSE left_over // cut + CASE WHEN i < left_over % cut THEN 1 ELSE 0 END END AS BIGINT)"


@query("w10_budget", f"{SHARES} SELECT conv_id, turn, {SHARE} AS share FROM l")
def w10_budget(spark, sf_dir):
    """A conversation's turns share a budget of characters."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n")).where("n > 0")
    return budget.shares(c, "conv_id", "n", "turn", BUDGET).select("conv_id", "turn", "share")


@query("w10_contents", f"""{SHARES}, f AS (SELECT conv_id, turn, n, {SHARE} AS share FROM l), t AS (SELECT f.*, text FROM f JOIN conversations c ON f.conv_id = c.conv_id AND f.turn = c.turn)
SELECT conv_id, turn, CASE WHEN n <= share THEN text WHEN share = 1 THEN '…' ELSE regexp_replace(substr(text, 1, share - 1), '\\s+$', '') || '…' END AS text, share, n > share AS truncated FROM t WHERE share > 0""")
def w10_contents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return budget.allocate(c, "conv_id", "text", "turn", BUDGET)


_site = lambda u: f"regexp_extract({u}, '^https?://([^/?#]+)', 1)"


@query("e7_cited_sources", rf"""WITH RECURSIVE p AS (SELECT page_id, url, {_site('url')} AS site FROM pages WHERE {WEB}),
l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages),
o AS (SELECT p.page_id, p.url, site, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE href END AS target FROM l JOIN p ON l.page_id = p.page_id WHERE href <> ''),
e AS (SELECT DISTINCT page_id, regexp_replace(target, '#.*$', '') AS target FROM o WHERE regexp_matches(target, '^https?://') AND {_site('target')} = site),
f(page_id, target, depth) AS (SELECT page_id, target, 1 FROM e UNION SELECT f.page_id, e.target, f.depth + 1 FROM f JOIN p ON p.url = f.target JOIN e ON e.page_id = p.page_id WHERE f.depth < 3)
SELECT page_id, target AS url, CAST(min(depth) AS INT) AS depth, CAST(round(0.025 * least(len(list_filter(string_split(regexp_extract(target, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')), 6), 6) AS DOUBLE) AS score FROM f GROUP BY page_id, target""")
def e7_cited_sources(spark, sf_dir):
    """Links of pages to their own site, followed three steps where they lead to other pages."""
    return follow.scored(follow.followed(table(spark, sf_dir, "pages"), 3))
