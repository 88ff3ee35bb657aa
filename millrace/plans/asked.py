"""Rewrites and plans of questions, over every turn of the conversations, with SQL twins that go list by list."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fixed, intent
from millrace.operators import planner, rank
from millrace.plans import scalars, sql
from millrace.plans.registry import query, table
from millrace.plans.scalars import FRESH, FULL, Q_SQL, any_of, pair_of
from millrace.sources import scans

ALNUM = r"\p{L}\p{N}"


def kept(x: str, condition: str) -> str:
    """Items ``v`` (at ``i``) of a list for which a condition holds."""
    return f"list_filter({x}, lambda v, i: {condition})"


def each(x: str, value: str) -> str:
    return f"list_transform({x}, lambda v: {value})"


def edged(x: str, more: str = "") -> str:
    """Without characters other than letters, digits and ``more`` at either end."""
    other = rf"[^{ALNUM}{more}]+"
    return f"regexp_replace({x}, '^{other}|{other}$', '', 'g')"


def among(x: str, values) -> str:
    return f"list_contains({sql.arr(values)}, {x})"


def compacted(name: str, context: str) -> str:
    words = kept(each(context, edged("v", "_:.+#-")), f"regexp_matches(v, '[{ALNUM}]') AND NOT {among(sql.low('v'), fixed.DIAGNOSTIC_STOP)}") + "[1:8]"
    return f"'\"' || {name} || '\"' || CASE WHEN len({words}) > 0 THEN ' ' || array_to_string({words}, ' ') ELSE '' END"


_good = f"len({sql.tokens('v')}) >= 3 AND (list_has_any({sql.tokens('v')}, {sql.arr(fixed.DIAGNOSTIC_MARKERS)}) OR {scalars._contains('v', fixed.NOT_DIAGNOSTICS)})"
_name = f"regexp_matches(v, '_|::') AND length(regexp_replace(v, '[^{ALNUM}]', '', 'g')) >= 2"
_code = rf"nullif(regexp_extract(' ' || query || ' ', '[^{ALNUM}]((?:{'|'.join(fixed.ERROR_CODE_PREFIXES)})[0-9]{{3,5}})[^{ALNUM}]', 1), '')"
_or_query = lambda x: f"coalesce(nullif(array_to_string({x}, ' '), ''), query)"
_day = lambda x: f"coalesce(TRY_CAST(regexp_extract({x}, '^([0-9]{{1,2}})(st|nd|rd|th)?$', 1) AS INT) BETWEEN 1 AND 31, false)"
_year = lambda x: f"coalesce(regexp_full_match({x}, '[0-9]{{4}}') AND TRY_CAST({x} AS INT) BETWEEN {fixed.FIRST_YEAR} AND {fixed.LAST_YEAR}, false)"
_dated = f"({_day('b[i + 1]')} OR {_year('b[i + 1]')} OR (i > 1 AND coalesce({among('b[i - 1]', fixed.DATE_INTRODUCTIONS)}, false)))"

#: Of each question: tokens t, words w, bare lower-cased words b, and the pieces that rewrites are made of.
PIECES = f"""q1 AS (SELECT *, {scalars.TOK} AS t, {sql.words('query')} AS w, regexp_extract_all(query, '"([^"]*)"', 1) AS quotes FROM q),
q2 AS (SELECT *, {each('w', sql.low(edged('v')))} AS b, {each('w', edged('v'))} AS bare, {each('w', edged('v', '_:'))} AS names, {kept('quotes', _good)}[1] AS diagnostic,
  CASE WHEN length({sql.strip('quotes[1]')}) >= 4 THEN {sql.strip('quotes[1]')} END AS phrase, {_code} AS code FROM q1),
q3 AS (SELECT *, {kept('names', _name)}[1] AS name, list_transform(w, lambda v, i: coalesce({among('b[i]', fixed.MONTHS)} AND {_dated}, false)) AS months FROM q2),
q4 AS (SELECT *, list_position(names, name) AS spot, instr(query, '"' || diagnostic || '"') AS start, list_transform(w, lambda v, i: i > 1 AND coalesce(months[i - 1], false) AND {_day('b[i]')}) AS days FROM q3),
q5 AS (SELECT *, {kept(each('list_concat(w[spot + 1:], list_reverse(w[1:spot - 1]))', edged('v')), f"strlen(v) >= 3 AND NOT {among(sql.low('v'), fixed.COMPANION_STOP)}")}[1] AS companion,
  {sql.words('substr(query, 1, start - 1)')} AS before, {sql.words('substr(query, start + length(diagnostic) + 2)')} AS after FROM q4),
q6 AS (SELECT *, CASE WHEN diagnostic IS NOT NULL THEN {compacted('diagnostic', 'list_concat(before, after)')} WHEN code IS NOT NULL THEN {compacted('code', kept('w', 'bare[i] <> code'))}
    WHEN name IS NOT NULL THEN '"' || name || '"' || CASE WHEN contains(name, '::') OR companion IS NULL THEN '' ELSE ' ' || companion END END AS exact,
  {_or_query(kept('w', f"NOT (months[i] OR days[i] OR (i > 1 AND (coalesce(months[i - 1], false) OR coalesce(days[i - 1], false)) AND {_year('b[i]')}) OR {among('b[i]', fixed.NEWS_DROPPED)})"))} AS without_news,
  {_or_query(kept('w', f"NOT {among('b[i]', fixed.MODIFIERS)}"))} AS plain, {kept('w', f"NOT {among('b[i]', fixed.PAPER_MARKERS)}")} AS titled FROM q5),
q7 AS (SELECT *, CASE WHEN (contains({sql.low('query')}, 'original paper') OR (list_contains(t, 'arxiv') AND list_contains(t, 'paper') AND NOT {any_of(fixed.EXPLORATORY, 't')})) AND len(titled) >= 3 THEN array_to_string(titled, ' ') END AS paper,
  list_contains(t, 'cpu') AND list_contains(t, 'cuda') AND {any_of(['drift', 'reproducibility'], 't')} AND {any_of(['numerical', 'tolerance'], 't')} AS parity FROM q6)"""
PARTS = f"{Q_SQL},\n{PIECES}"

PARITY = "'cpu cuda numerical tolerance'"


@query("q1_rewrites", f"WITH {PARTS} SELECT query_id, exact, diagnostic, phrase, without_news AS news, coalesce(exact, CASE WHEN parity THEN {PARITY} END) AS issue, paper FROM q7")
def q1_rewrites(spark, sf_dir):
    """Q1, Q2, Q5, Q12, Q15, Q19, Q21."""
    q = F.col("query")
    return scalars.questions(spark, sf_dir).select("query_id", intent.exact_identifier(q).alias("exact"), intent.quoted_diagnostic(q).alias("diagnostic"), intent.quoted_phrase(q).alias("phrase"), intent.normalized_news(q).alias("news"), intent.issue_query(q).alias("issue"), intent.paper_title(q).alias("paper"))


# ---- intent and the named site
IT = scalars.it_sql("exact IS NOT NULL")
NEWS = f"CASE WHEN {any_of(fixed.EXPLICIT_NEWS)} THEN {FRESH} OR NOT it ELSE {FRESH} AND {any_of(fixed.EVENTS)} END"
SCHOLARLY = any_of(fixed.SCHOLARLY_WORDS)
SCIENCE = f"({any_of(fixed.EXPLICIT_SCHOLARLY)} OR {pair_of(fixed.SCHOLARLY_PAIRS)} OR {any_of(fixed.DISTINCTIVE_SUBJECTS)} OR ({any_of(fixed.BROAD_SUBJECTS)} AND ({SCHOLARLY} OR {any_of(fixed.RESEARCH_CUES)})))"
DIAGNOSED = rf"(phrase IS NOT NULL AND (regexp_matches(' ' || query || ' ', '[^{ALNUM}][A-Za-z]{{1,4}}[0-9]{{3,5}}[^{ALNUM}]') OR {any_of(fixed.DIAGNOSTIC_WORDS)}))"
ASKS_SOURCE = f"(list_contains(t, 'arxiv') OR ({FULL}) OR {scalars._contains('query', ['original paper', 'primary source', 'release notes'])} OR list_has_any(b, {sql.arr(fixed.SOURCE_WORDS)}))"


def occurs(rule: str) -> str:
    """All groups of a rule occur among the tokens."""
    return " AND ".join(f"regexp_matches(flat, ' ({group.replace('+', ' ')}) ')" for group in rule.split(" "))


_sites = [f"WHEN diagnosed AND {occurs(rule)} THEN '{host}'" for rule, host in fixed.DIAGNOSTIC_SITES] + [f"WHEN {occurs(rule)} THEN '{host}'" for rule, host in fixed.NAMED_SITES]
_single = " ".join(f"WHEN '{word}' THEN '{host}'" for word, host in fixed.SINGLE_WORD_SITES.items())
SITE = f"""CASE WHEN contains({sql.low('query')}, 'next.js') THEN 'nextjs.org' WHEN {occurs('pip')} AND contains({sql.low('query')}, 'externally-managed-environment') THEN 'packaging.python.org'
  {" ".join(_sites)} WHEN {occurs('rfc')} AND len({kept('t', "regexp_full_match(v, '[0-9]+')")}) > 0 THEN 'rfc-editor.org'
  ELSE coalesce(CASE {kept('t', among('v', fixed.SINGLE_WORD_SITES))}[1] {_single} END,
    CASE WHEN {occurs('world+health+organization|world+health+organisation')} OR list_contains(regexp_split_to_array(query, '[^{ALNUM}]+'), 'WHO') THEN 'who.int' END) END"""
INTENDED = f"""{PIECES},
q8 AS (SELECT *, {IT} AS it, ' ' || array_to_string(t, ' ') || ' ' AS flat, {DIAGNOSED} AS diagnosed FROM q7),
q9 AS (SELECT *, {NEWS} AS news, {SITE} AS site FROM q8)"""
INTENT = f"{Q_SQL},\n{INTENDED}"

_terms = kept("t", f"strlen(v) >= 3 AND NOT {among('v', fixed.IDENTITY_STOP)}")


@query("p8_reservations", f"""WITH {INTENT} SELECT query_id, site AS named, site IS NOT NULL AND NOT diagnosed AND {any_of(fixed.AUTHORITY_DOCUMENTS, 't')} AS reserves, {ASKS_SOURCE} AS source,
  it AND (exact IS NOT NULL OR phrase IS NOT NULL OR {any_of(fixed.QUESTION_ERRORS, 't')}) AS asks, CAST(CASE WHEN NOT {ASKS_SOURCE} THEN 0 WHEN list_contains({_terms}, 'tokio') THEN 0.12 ELSE -0.18 END AS DOUBLE) AS scope,
  'https://www.stackprinter.com/export?question=' || query_id % 1000 || '&service=stackoverflow&language=en&hideAnswers=false&showAll=true&width=640' AS printer, true AS wall FROM q9""")
def p8_reservations(spark, sf_dir):
    """P6, P8, P9, Q20, S21, U12, W2."""
    named = planner.authority_host(F.col("query"))
    page = F.lit("https://docs.rs/tokio/latest")
    number = (F.col("query_id") % 1000).cast("string")
    return scalars.questions(spark, sf_dir).select(
        "query_id",
        named.alias("named"),
        intent.reserves_authority(F.col("query"), named).alias("reserves"),
        intent.source(F.col("query")).alias("source"),
        intent.asks_questions(F.col("query")).alias("asks"),
        rank.project_scope(F.col("query"), page).alias("scope"),
        scans.printer_url(F.concat(F.lit("https://stackoverflow.com/questions/"), number)).alias("printer"),
        scans.is_wall(F.lit("https://www.reddit.com/login"), F.lit("")).alias("wall"),
    )


# ---- plans
_month_or_year = lambda x: f"({among(x, fixed.MONTHS)} OR (regexp_full_match({x}, '[0-9]{{4}}') AND TRY_CAST({x} AS INT) BETWEEN {fixed.FIRST_YEAR} AND {fixed.LAST_YEAR}))"
#: Places between which only parts of a date follow an "as of".
_opens = "list_filter(range(1, len(t)), lambda s: t[s] = 'as' AND t[s + 1] = 'of')"
_others = f"list_filter(range(1, len(t) + 1), lambda i: t[i] <> 'the' AND NOT {among('t[i]', fixed.MONTHS)} AND NOT regexp_full_match(t[i], '[0-9]+(st|nd|rd|th)?'))"
_clauses = "list_transform(opens, lambda s: [s + 2, coalesce(list_filter(others, lambda o: o >= s + 2)[1], len(t) + 1)])"
_counting = kept("t", f"NOT ({_month_or_year('v')} AND len(list_filter(clauses, lambda c: c[1] <= i AND i < c[2])) > 0) AND strlen(v) >= 3 AND NOT {among('v', fixed.LEXICAL_STOP)}")
_years = "list_filter(list_transform(regexp_extract_all(query, '[0-9]+'), lambda d: TRY_CAST(d AS INT)), lambda y: y BETWEEN 1900 AND 2200)"
_kind = f"CASE {kept('t', among('v', planner.RECOMMENDATION_KINDS))}[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in planner.RECOMMENDATION_KINDS.items()) + " END"
_brand_names = kept("bare", f"{among(sql.low('v'), fixed.STRONG_BRANDS)} OR regexp_matches(v, '^[A-Z][a-z]')")
_part = rf"regexp_extract(query, '(?i)\b((?:article|section|clause|chapter) [{ALNUM}]{{1,12}})\b', 1)"
_rest = kept(sql.words("replace(regexp_replace(query, '(?i)full[- ]?text', ' ', 'g'), part, ' ')"), f"NOT {among('lower(' + edged('v') + ')', ['of', 'the', 'text', 'full'])}")
_place = lambda x: kept(each(x, edged("v")), f"v <> '' AND NOT {among('lower(v)', ['the', 'a', 'an', 'best', 'closest', 'nearby', 'open', 'good'])}")
_telling = kept("bare[1:12]", f"v <> '' AND NOT {among(sql.low('v'), planner.TECHNICAL_FILLER)}")
_technical = f"""CASE WHEN phrase IS NOT NULL THEN {compacted('phrase', sql.words("replace(query, '\"' || phrase || '\"', ' ')"))} WHEN len(telling) >= 3 THEN array_to_string(telling, ' ') END"""


def item(kind: str, text: str, more: str = "", strict: str = "false") -> str:
    return f"""'{{"kind":"{kind}","query":' || CAST(to_json({text}) AS VARCHAR) || '{more},"strict":{strict}}}'"""


PLANS = f"""{INTENT},
l1 AS (SELECT *, {_opens} AS opens, {_others} AS others FROM q9),
l2 AS (SELECT *, {_clauses} AS clauses FROM l1),
l3 AS (SELECT *, {_counting} AS counting FROM l2),
p1 AS (SELECT *, {_years}[1] AS year, upper({kept('t', among('v', fixed.ISSUERS))}[1]) AS issuer, {_kind} AS kind, {scalars.once('counting')} AS lexical, {_part} AS part, list_position({each('w', 'lower(v)')}, 'near') AS near, {_telling} AS telling,
  {_brand_names} AS brands, {SCIENCE} AS science, {SCHOLARLY} AS scholarly, {scalars._contains('query', ['case study', 'case studies'])} AS study FROM l3),
p2 AS (SELECT *, {kept('lexical', f"NOT regexp_full_match(v, '[0-9]+') AND NOT {among('v', fixed.MONTHS)} AND v <> lower(issuer)")} AS subject, {_rest} AS rest, {kept('brands', f"list_position({each('brands', 'lower(v)')}, lower(v)) = list_position(brands, v)")} AS first_brands,
  {_place('w[1:near - 1]')} AS things, {_place('w[near + 1:]')} AS place, CASE WHEN news THEN 'news' WHEN science AND scholarly THEN 'science' WHEN it THEN 'it' WHEN science THEN 'science' END AS extra,
  (contains({sql.low('query')}, ' near ') OR contains({sql.low('query')}, ' nearby') OR contains({sql.low('query')}, ' closest ')) AND NOT {any_of(['hike', 'hikes', 'hiking', 'trail', 'trails'], 't')} AND near > 1 AS local FROM p1),
p3 AS (SELECT *, [
  CASE WHEN year IS NOT NULL AND issuer IS NOT NULL AND kind IS NOT NULL AND len(subject) > 0 THEN {item('focused', "'\"' || year || ' ' || issuer || ' ' || kind || '\" ' || array_to_string(subject[1:2], ' ')")} END,
  CASE WHEN ({FULL}) AND part <> '' AND len(rest) >= 2 THEN {item('full_text', "'\"' || array_to_string(rest, ' ') || '\" \"' || part || '\"'")} END,
  CASE WHEN parity THEN {item('focused', PARITY)} END,
  CASE WHEN study THEN {item('focused', "array_to_string(first_brands[1:4], ' OR ') || ' (migration OR \"case study\" OR postmortem)'")} END,
  CASE WHEN {scalars._strict} AND site IS NOT NULL THEN {item('source', "plain || ' site:' || site", ''',"host":"' || site || '"''', 'true')} END,
  CASE WHEN local THEN {item('local', "array_to_string(list_concat(things[-3:], place[1:4]), ' ')", ',"target":"map"')} END,
  CASE WHEN extra = 'news' THEN {item('specialist', 'without_news', ',"target":"news"')} END,
  CASE WHEN extra <> 'news' THEN {item('specialist', f"coalesce(CASE WHEN it THEN {_technical} END, plain)", ''',"target":"' || extra || '"''')} END] AS found FROM p2)"""


@query("q6_plans", f"""WITH {PLANS} SELECT query_id, coalesce('"' || paper || '"', query) AS primary_query, 'general' AS categories, '[' || array_to_string({kept('found', 'v IS NOT NULL')}[1:2], ',') || ']' AS supplements FROM p3""")
def q6_plans(spark, sf_dir):
    """Q6 to Q11, Q13, Q16 to Q18, Q20, Q22: which scans a query asks for."""
    return planner.plan(scalars.questions(spark, sf_dir), "general, it, science, news, map").select("query_id", "primary_query", "categories", F.to_json("supplements").alias("supplements"))


# ---- candidates
#: Questions that candidates are scored for, one for each row by turns, what stands before their titles, and the newest date.
ASKED = ["current inflation rate Canada May 2024", "bazel migration case study", "latest release notes 2024"]
TITLED = ["", "Bazel migration case study: ", "Inflation in Canada, May 2024: ", "Old post of 2020: "]
NEWEST = 2024 * 372 + 4 * 31 + 19


def candidates(spark, sf_dir):
    """Pages as candidates: id, query, url, title, snippet, date, dense, evidence, recommendation, named."""
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    dressed = F.concat(scalars.turn(TITLED, k % len(TITLED)), title)
    date = F.when(k % 5 < 3, F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (k % 900).cast("int")), "yyyy-MM-dd"))
    return table(spark, sf_dir, "pages").where("url is not null").select(k.alias("id"), scalars.turn(ASKED, k % len(ASKED)).alias("query"), "url", dressed.alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("snippet"), date.alias("date"), ((k % 10) / 10).alias("dense"), ((k % 7) / 7).alias("evidence"), (k % 2).cast("double").alias("recommendation"), F.when(k % 6 == 0, "example.org").alias("named"))


_first = lambda width, value: f"list_filter(list_transform(range(1, len(t) - {width - 2}), lambda i: {value}), lambda v: v IS NOT NULL)[1]"
_matches = lambda name: f"coalesce(len({_split(name)}) > 0 AND len(list_filter({_split(name)}, lambda v: NOT list_contains(terms, {sql.low('v')}))) = 0, false)"
_split = lambda name: f"list_filter(regexp_split_to_array({name}, '[^{ALNUM}]+'), lambda v: strlen(v) >= 2 AND v NOT IN ('crate', 'rs'))"
_urls = scalars._key(*[scalars._int(f"s[i{k}]") for k in ("", " + 1", " + 2")])
_ends = " OR ".join(f"ends_with(h, '{e}')" for e in (".gov", ".edu", ".int", ".ac.uk"))
_record = "(h = 'arxiv.org' OR ends_with(h, '.arxiv.org') OR h IN ('doi.org', 'dx.doi.org') OR contains(path, '/doi/'))"
_package = "CASE WHEN h = 'docs.rs' THEN CASE WHEN s[1] = 'crate' THEN s[2] ELSE s[1] END WHEN s[1] = 'crates' THEN s[2] END"
SCOPE = f"""CASE WHEN h = 'github.com' AND {_matches('s[2]')} AND asks THEN 0.10 WHEN h = 'github.com' AND {_matches('s[2]')} AND exact IS NOT NULL AND NOT {among('lower(s[2])', fixed.LANGUAGE_REPOSITORIES)} THEN 0.08 WHEN NOT asks THEN 0
  WHEN h IN ('docs.rs', 'crates.io', 'lib.rs') THEN CASE WHEN coalesce(package, '') = '' THEN 0 WHEN {_matches('package')} THEN 0.12 ELSE -0.18 END WHEN {_matches("string_split(h, '.')[1]")} THEN 0.10 ELSE 0 END"""
_path_terms = kept("qt", f"strlen(v) >= 3 AND NOT {among('v', fixed.PATH_STOP)} AND contains(lower(path), v)")
SITE_BONUS = f"""greatest(CASE WHEN ends_with(h, '.gov') AND {any_of(fixed.PUBLIC_INFORMATION, 'qt')} AND list_has_any(string_split(h, '.'), {kept('qt', 'strlen(v) >= 4')}) THEN 0.12 ELSE 0 END,
  CASE WHEN coalesce(h = named OR ends_with(h, '.' || named), false) THEN CASE WHEN diagnosed AND NOT strict THEN 0.04 ELSE 0.12 END + CASE WHEN len({_path_terms}) >= 2 THEN 0.05 ELSE 0 END
  WHEN {_ends} OR (research AND {_record}) THEN 0.04 ELSE 0 END)"""
STUDIED = f"""study AND (list_has_any(list_transform(range(1, len(tt)), lambda i: tt[i] || ' ' || tt[i + 1]), ['case study', 'case studies']) OR (len({kept('tt', "starts_with(v, 'adopt') OR starts_with(v, 'migrat')")}) > 0 AND list_has_any(tt, ['experience', 'journey', 'lessons'])))
  AND list_has_any(tt, {kept('terms', f"NOT {among('v', fixed.CASE_STUDY_GENERIC)}")})"""
_stepped = lambda x, steps, rest: "CASE " + " ".join(f"WHEN {x} {test} THEN {v}" for test, v in steps) + f" ELSE {rest} END"
_studies = scalars._contains("query", ["case study", "case studies"])
_year_list = "list_filter(list_transform(regexp_extract_all({}, '[0-9]+'), lambda d: TRY_CAST(d AS INT)), lambda y: y BETWEEN 1900 AND 2200)"

#: No question of ``ASKED`` requests a title, so the twin has no exact titles (``t9_exact_titles`` has them).
SCORES = f"""WITH c AS (SELECT page_id AS id, {sql.arr(ASKED)}[page_id % {len(ASKED)} + 1] AS query, url, {sql.arr(TITLED)}[page_id % {len(TITLED)} + 1] || {scalars.TITLE} AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS snippet,
  CASE WHEN page_id % 5 < 3 THEN DATE '2022-01-01' + CAST(page_id % 900 AS INT) END AS date, page_id % 10 / 10 AS dense, page_id % 7 / 7 AS evidence, page_id % 2 AS recommendation, CASE WHEN page_id % 6 = 0 THEN 'example.org' END AS named FROM pages WHERE url IS NOT NULL),
q AS (SELECT DISTINCT query AS query_id, query FROM c),
{INTENDED},
a AS (SELECT query, exact, diagnosed, t AS qt, {_terms} AS terms, {scalars._strict} AS strict, {ASKS_SOURCE} AS asks, {_studies} AS study, {any_of(fixed.RESEARCH_WORDS)} OR (NOT {_studies} AND {any_of(['study', 'studies'])}) AS research,
  {any_of(fixed.RECENCY)} OR (list_contains(t, 'current') AND {any_of(fixed.TEMPORAL_NOUNS)}) AS recent, {FRESH} OR {pair_of(['as of'])} AS as_of, {any_of(['timeline', 'history'])} AS timeline,
  {_first(3, scalars._date)} AS day, {_first(2, scalars._period)} AS month, {_year_list.format('query')}[1] AS year FROM q9),
m AS (SELECT id, list_filter(regexp_split_to_array(title || ' ' || snippet, '[^{ALNUM}]+'), lambda v: v <> '') AS t FROM c),
n AS (SELECT id, {_first(2, scalars._period)} AS stated FROM m),
u AS (SELECT c.*, {scalars.HOST} AS h, {scalars.PATH} AS path, {sql.tokens('title')} AS tt, {_year_list.format("title || ' ' || snippet")} AS years, year(date) * 372 + (month(date) - 1) * 31 + day(date) - 1 AS dated FROM c),
v AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS s FROM u),
x AS (SELECT *, {_package} AS package, coalesce(dated, list_filter(list_transform(range(1, len(s) - 1), lambda i: {_urls}), lambda v: v IS NOT NULL)[1]) AS hit FROM v),
y AS (SELECT x.*, a.* EXCLUDE (query), n.stated, {SCOPE} AS scope FROM x JOIN a ON x.query = a.query JOIN n ON x.id = n.id),
z AS (SELECT *, {NEWEST} - hit AS age, abs(day - hit) AS apart, month - coalesce(stated, dated // 31, hit // 31) AS months_apart FROM y)
SELECT id, round(CAST(dense + CASE WHEN scope <> 0 THEN scope ELSE {SITE_BONUS} END
  + CASE WHEN recent AND age IS NOT NULL THEN {_stepped('age', [('<= 31', 0), ('<= 183', -0.015), ('<= 372', -0.03), ('<= 744', -0.06)], -0.10)} ELSE 0 END
  + {_stepped('apart', [('= 0', 0.12), ('= 1', 0.04)], 0)} + CASE WHEN day IS NULL AND NOT as_of AND months_apart IS NOT NULL THEN {_stepped('months_apart', [('= 0', 0.12), ('= 1', 0.08), ('= 2', -0.04), ('>= 3', -0.10)], -0.03)} ELSE 0 END
  + {fixed.EVIDENCE_WEIGHT} * evidence + {fixed.RECOMMENDATION_WEIGHT} * recommendation
  + CASE WHEN (as_of AND NOT timeline) OR year IS NULL THEN 0 WHEN list_contains(years, year) THEN 0.03 WHEN len(list_filter(years, lambda w: w <= year - 2)) > 0 THEN -0.08 ELSE 0 END
  + CASE WHEN {STUDIED} THEN {fixed.CASE_STUDY_WEIGHT} ELSE 0 END AS DOUBLE), 6) AS score FROM z"""


@query("w1_candidate_scores", SCORES)
def w1_candidate_scores(spark, sf_dir):
    """The whole sum for pages as candidates of three questions by turns."""
    return candidates(spark, sf_dir).select("id", F.round(rank.candidate_score(F.col("query"), F.lit(NEWEST)), 6).alias("score"))
