"""Query planning: which scans a question asks for, as columns of the query table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed, intent, text

SUPPLEMENT = "array<struct<kind:string,query:string,target:string,host:string,strict:boolean>>"
TECHNICAL_FILLER = "a an and are can do does for from how i in into is my of on or should the to using what when why with".split()
RECOMMENDATION_KINDS = {"guideline": "Guideline", "guidelines": "Guideline", "recommendation": "Recommendation", "recommendations": "Recommendation", "standards": "Standards"}
DOCUMENT_KINDS = "api docs documentation guide manual notes reference release releases spec specification standard tutorial".split()


def supplement(kind: str, query: Column, target: Column | None = None, host: Column | None = None, strict: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), query.alias("query"), (target if target is not None else none).alias("target"), (host if host is not None else none).alias("host"), F.coalesce(strict if strict is not None else F.lit(False), F.lit(False)).alias("strict"))


def focused_technical(query: Column) -> Column:
    """A quoted phrase with its context, or the telling ones of the first twelve words (three at least)."""
    phrase = intent.quoted_phrase(query)
    quoted = F.concat(F.lit('"'), phrase, F.lit('"'))
    around = text.split_space(F.replace(query, quoted, F.lit(" ")))
    ws = F.filter(F.transform(F.slice(text.split_space(query), 1, 12), intent.bare), lambda w: (w != "") & ~text.ascii_lower(w).isin(TECHNICAL_FILLER))
    return F.when(phrase.isNotNull(), intent.compact(phrase, around)).when(F.size(ws) >= 3, F.array_join(ws, " "))


def focused_recommendation(query: Column) -> Column:
    """``"YEAR ISSUER Kind" term term`` for a question that names a year, an issuer and a kind of document."""
    ts = text.tokens(query)
    year, issuer = F.get(text.years(query), 0), intent.issuer(query)
    kinds = F.create_map(*[F.lit(v) for p in RECOMMENDATION_KINDS.items() for v in p])
    kind = F.try_element_at(kinds, F.get(F.filter(ts, lambda t: t.isin(list(RECOMMENDATION_KINDS))), 0))
    subject = F.filter(text.lexical_terms(query), lambda t: ~text.is_digits(t) & ~text.is_month(t) & (t != F.lower(issuer)))
    return F.when(year.isNotNull() & issuer.isNotNull() & kind.isNotNull() & (F.size(subject) > 0), F.concat(F.lit('"'), year.cast("string"), F.lit(" "), issuer, F.lit(" "), kind, F.lit('" '), F.array_join(F.slice(subject, 1, 2), " ")))


def focused_case_study(query: Column) -> Column:
    """Up to four distinct names of the query, and what case studies are called."""
    names = F.filter(F.transform(text.split_space(query), intent.bare), lambda w: text.ascii_lower(w).isin(fixed.STRONG_BRANDS) | w.rlike("^[A-Z][a-z]"))
    first = lambda n: F.filter(n["names"], lambda w: F.array_position(n["low"], F.lower(w)) == F.array_position(n["names"], w))
    distinct = text.let(names, lambda n: text.let(F.struct(n.alias("names"), F.transform(n, F.lower).alias("low")), first))
    return F.concat(F.array_join(F.slice(distinct, 1, 4), " OR "), F.lit(' (migration OR "case study" OR postmortem)'))


def map_query(query: Column) -> Column:
    """Three words of the subject and four of the place, for questions about something near a place."""
    low = text.ascii_lower(query)
    local = low.contains(" near ") | low.contains(" nearby") | low.contains(" closest ")
    walks = text.has_any(text.tokens(query), ["hike", "hikes", "hiking", "trail", "trails"])
    ws = text.split_space(query)
    at = F.array_position(F.transform(ws, F.lower), "near").cast("int")
    clean = lambda xs: F.filter(F.transform(xs, intent.bare), lambda w: (w != "") & ~F.lower(w).isin("the", "a", "an", "best", "closest", "nearby", "open", "good"))
    subject = F.slice(F.reverse(clean(F.slice(ws, F.lit(1), F.greatest(at - 1, F.lit(0))))), 1, 3)
    place = F.slice(clean(F.slice(ws, at + 1, F.size(ws))), 1, 4)
    return F.when(local & ~walks & (at > 1), F.concat_ws(" ", F.reverse(subject), place))


def locator_query(query: Column) -> Column:
    """``"instrument" "Article 5"`` for a full text and its part."""
    part = F.regexp_extract(query, r"(?i)\b((?:article|section|clause|chapter) [\p{IsAlphabetic}\p{N}]{1,12})\b", 1)
    rest = F.filter(text.split_space(F.replace(F.regexp_replace(query, "(?i)full[- ]?text", " "), part, F.lit(" "))), lambda w: ~F.lower(intent.bare(w)).isin("of", "the", "text", "full"))
    return F.when(intent.full_text(query) & (part != "") & (F.size(rest) >= 2), F.concat(F.lit('"'), F.array_join(rest, " "), F.lit('" "'), part, F.lit('"')))


def authority_host(query: Column) -> Column:
    """The site that a query names, by the first rule that fits; else null."""
    return text.let(F.struct(query.alias("query"), text.tokens(query).alias("tokens"), F.coalesce(intent.has_quoted_diagnostic(query), F.lit(False)).alias("diagnosed")), named_site)


def named_site(given: Column) -> Column:
    """``authority_host`` of a question's tokens, which are bound to a name."""
    query, ts, diagnosed = given["query"], given["tokens"], given["diagnosed"]
    low = text.ascii_lower(query)

    def by_rule(flat: Column) -> Column:
        def occurs(group: str) -> Column:
            return flat.rlike(f" (?:{group.replace('+', ' ')}) ")

        def fits(rule: str) -> Column:
            out = F.lit(True)
            for group in rule.split(" "):
                out = out & occurs(group)
            return out

        out = F.when(low.contains("next.js"), "nextjs.org").when(occurs("pip") & low.contains("externally-managed-environment"), "packaging.python.org")
        for rule, host in fixed.DIAGNOSTIC_SITES:
            out = out.when(diagnosed & fits(rule), host)
        for rule, host in fixed.NAMED_SITES:
            out = out.when(fits(rule), host)
        out = out.when(occurs("rfc") & F.exists(ts, text.is_digits), "rfc-editor.org")
        single = F.create_map(*[F.lit(v) for pair in fixed.SINGLE_WORD_SITES.items() for v in pair])
        first = F.get(F.filter(ts, lambda t: t.isin(list(fixed.SINGLE_WORD_SITES))), 0)
        who = occurs("world+health+organization|world+health+organisation") | F.array_contains(F.split(query, text.NOT_WORD), "WHO")
        return out.otherwise(F.coalesce(F.try_element_at(single, first), F.when(who, "who.int")))

    return text.let(F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" ")), by_rule)


def manifestation_query(query: Column, title: Column) -> Column:
    """A scholarly result's title (four words) with the query's years, for a search in scholarly indexes."""
    years = F.array_join(F.transform(text.years(query), lambda y: y.cast("string")), " ")
    return F.when(intent.scholarly(query) & (F.size(text.tokens(title)) >= 4), F.trim(F.concat_ws(" ", title, years)))


def wanted(query: Column) -> Column:
    """Which special categories a query asks for: news, science, it, and science with words of scholars."""
    return F.struct(F.coalesce(intent.news(query), F.lit(False)).alias("news"), F.coalesce(intent.science(query), F.lit(False)).alias("science"), F.coalesce(intent.it(query), F.lit(False)).alias("it"), F.coalesce(intent.scholarly(query), F.lit(False)).alias("scholarly"))


def extra_category(asked: Column, configured: str) -> Column:
    """The category searched besides a general one: news, then science where it is asked for, then it.  ``asked``: see ``wanted``."""
    have = [c.strip() for c in configured.split(",")]
    out = F.when(F.lit(False), "")
    for name, asks in (("news", asked["news"]), ("science", asked["science"] & asked["scholarly"]), ("it", asked["it"]), ("science", asked["science"])):
        if name in have:
            out = out.when(asks, name)
    return out


def chosen_category(asked: Column, configured: str) -> Column:
    """The category searched first: general where it is configured, else the one asked for, else the first."""
    have = [c.strip() for c in configured.split(",")]
    return F.lit("general") if "general" in have else F.coalesce(extra_category(asked, configured), F.lit(have[0]))


def plan(queries: DataFrame, categories: str) -> DataFrame:
    """``queries`` (query_id, query) with primary_query, categories, time_range and up to two supplements.

    What several rules need is computed once, in columns of its own."""
    q = F.col("query")
    found = {
        "asked": wanted(q),
        "title": intent.paper_title(q),
        "plain": intent.normalized_modifiers(q),
        "site": F.when(intent.strict_source(q), authority_host(q)),
        "recommended": focused_recommendation(q),
        "locator": locator_query(q),
        "place": map_query(q),
        "technical": focused_technical(q),
    }
    known = queries.select(F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("row"), F.struct(*[v.alias(k) for k, v in found.items()]).alias("found"))
    q, found = F.col("row.query"), {k: F.col(f"found.{k}") for k in found}
    extra = extra_category(found["asked"], categories)
    known = known.select("*", extra.alias("extra"))
    extra = F.col("extra")
    rules = [
        F.when(found["recommended"].isNotNull(), supplement("focused", found["recommended"])),
        F.when(found["locator"].isNotNull(), supplement("full_text", found["locator"])),
        F.when(intent.numerical_parity(q), supplement("focused", F.lit("cpu cuda numerical tolerance"))),
        F.when(intent.case_study(q), supplement("focused", focused_case_study(q))),
        F.when(found["site"].isNotNull(), supplement("source", F.concat(found["plain"], F.lit(" site:"), found["site"]), host=found["site"], strict=F.lit(True))),
        F.when(found["place"].isNotNull() & F.lit("map" in categories), supplement("local", found["place"], target=F.lit("map"))),
        F.when(extra == "news", supplement("specialist", intent.normalized_news(q), target=F.lit("news"))),
        F.when(extra != "news", supplement("specialist", F.coalesce(F.when(found["asked"]["it"], found["technical"]), found["plain"]), target=extra)),
    ]
    chosen = F.slice(F.filter(F.array(*rules), lambda r: r.isNotNull()), 1, 2)
    return known.select(
        "row.*",
        F.coalesce(F.concat(F.lit('"'), found["title"], F.lit('"')), q).alias("primary_query"),
        chosen_category(found["asked"], categories).alias("categories"),
        F.when(extra == "news", intent.freshness_window(q)).alias("time_range"),
        chosen.cast(SUPPLEMENT).alias("supplements"),
    )
