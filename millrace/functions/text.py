"""Text and title functions: Column in, Column out, all inside whole-stage code."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def words_of(values) -> Column:
    """A literal array."""
    return F.array(*[F.lit(v) for v in values])


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def strip(x: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_space(x: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def collapse(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.array_join(split_space(x), " ")


def tokens(x: Column) -> Column:
    """Lower-cased (ASCII) alphanumeric runs, in order."""
    return F.filter(F.split(ascii_lower(x), NOT_WORD), lambda w: w != "")


def term_set(x: Column) -> Column:
    return F.array_distinct(tokens(x))


def has_any(items: Column, values) -> Column:
    return F.arrays_overlap(items, words_of(values))


def pairs(items: Column) -> Column:
    """Neighbouring items joined by a space."""
    rest = F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))
    return F.filter(F.zip_with(items, rest, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def item(items: Column, i) -> Column:
    """Item at a 0-based position, null beyond the ends."""
    return F.get(items, i)


def is_month(t: Column) -> Column:
    return t.isin(list(fixed.MONTHS))


def is_year(t: Column) -> Column:
    return t.rlike(r"^[0-9]{4}$") & F.coalesce(t.try_cast("int").between(fixed.FIRST_YEAR, fixed.LAST_YEAR), F.lit(False))


def is_digits(t: Column) -> Column:
    return t.rlike(r"^[0-9]+$")


def lexical_terms(query: Column) -> Column:
    """Distinct words of a query that count: not in a date after "as of", of three bytes or more, no stop words."""
    ts = tokens(query)
    # For every token: are we inside a date clause that "as of" opened?
    start = F.struct(F.lit("").alias("prev"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        part = is_month(t) | is_year(t) | is_digits(t) | t.rlike(r"^[0-9]+(st|nd|rd|th)$") | (t == "the")
        opened = (acc["prev"] == "as") & (t == "of")
        drop = acc["open"] & (is_month(t) | is_year(t))
        return F.struct(t.alias("prev"), (opened | (acc["open"] & part)).alias("open"), F.when(drop, acc["out"]).otherwise(F.concat(acc["out"], F.array(t))).alias("out"))

    kept = F.aggregate(ts, start, step)["out"]
    return F.array_distinct(F.filter(kept, lambda t: (F.octet_length(t) >= 3) & ~t.isin(fixed.LEXICAL_STOP)))


def identifiers(query: Column) -> Column:
    """Compound names (``a.b``, ``a::b``, ``a_b``) as lists of their parts; host names are left out."""
    raw = F.filter(split_space(query), lambda w: ~w.contains("://"))
    trimmed = F.transform(raw, lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}.:_]+|[^\p{IsAlphabetic}\p{N}.:_]+$", ""))
    named = F.filter(trimmed, lambda w: w.rlike("[.:_]"))
    parts = F.transform(named, lambda w: F.filter(F.split(ascii_lower(w), "[.:_]"), lambda p: p != ""))
    good = F.filter(parts, lambda p: (F.size(p) >= 2) & F.exists(p, lambda q: q.rlike(r"\p{IsAlphabetic}")) & ~F.element_at(p, -1).isin("com", "dev", "io", "net", "org"))
    return F.array_distinct(good)


def contains_identifier(text_tokens: Column, parts: Column) -> Column:
    """Are the parts an ordered subsequence of the tokens, with only other parts between them?

    Matching is a fold: ``at`` parts are matched so far; a token outside the parts starts again."""

    def from_start(i: Column) -> Column:
        rest = F.slice(text_tokens, i + 2, F.greatest(F.size(text_tokens), F.lit(1)))
        state = F.struct(F.lit(1).alias("at"), F.lit(True).alias("live"))
        done = F.aggregate(
            rest,
            state,
            lambda s, t: F.when(~s["live"] | (s["at"] >= F.size(parts)), s)
            .when(t == F.get(parts, s["at"]), F.struct((s["at"] + 1).alias("at"), F.lit(True).alias("live")))
            .otherwise(F.struct(s["at"].alias("at"), F.array_contains(parts, t).alias("live"))),
        )
        return done["at"] >= F.size(parts)

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(text_tokens) - 1, F.lit(0))), lambda i: F.get(text_tokens, i) == F.get(parts, F.lit(0)))
    return F.exists(starts, from_start)


def years(x: Column) -> Column:
    """Numbers in a text that are years."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"[0-9]+"), 0), lambda d: d.try_cast("int"))
    return F.filter(found, lambda y: y.between(fixed.FIRST_YEAR, fixed.LAST_YEAR))


def title_key(title: Column) -> Column:
    """Distinct words of a title; numbers of four digits and more that repeat are left out."""
    repeats = lambda ws, w: F.size(F.filter(ws, lambda v: v == w)) > 1
    kept = lambda ws: F.array_distinct(F.filter(ws, lambda w: ~(w.rlike(r"^[0-9]{4,}$") & repeats(ws, w))))
    return F.array_join(let(tokens(F.replace(title, F.lit("%20"), F.lit(" "))), kept), " ")


def title_keys_equivalent(a: Column, b: Column) -> Column:
    """Equal, or the shorter has four words, two thirds of the longer, and begins it."""
    x, y = split_space(a), split_space(b)
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    return (a == b) | ((F.size(short) >= 4) & (F.size(short) * 3 >= F.size(long) * 2) & (F.slice(long, 1, F.greatest(F.size(short), F.lit(1))) == short))


def doi(x: Column) -> Column:
    y = F.regexp_replace(strip(x), r"^(doi:)*(https://doi\.org/)*(http://doi\.org/)*", "")
    return F.nullif(ascii_lower(strip(y)), F.lit(""))


def truncate(x: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis where some are cut."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def fit(x: Column, n: Column) -> Column:
    """Content within a budget of n characters."""
    cut = F.concat(F.regexp_replace(F.substring(x, F.lit(1), n - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(x) <= n, x).when(n <= 0, "").when(n == 1, "…").otherwise(cut)


def response_marker(title: Column) -> Column:
    """(response, subject): tags in brackets and prefixes of replies are taken off."""
    prefixes = "|".join(p.replace(" ", r"\ ") for p in fixed.RESPONSE_PREFIXES)
    head = F.regexp_extract(title, rf"(?i)^(?:\s*(?:\[[^\]]*\]|{prefixes}))*", 0)
    without = F.regexp_replace(head, r"\[[^\]]*\]", "")
    return F.struct(without.rlike(rf"(?i){prefixes}").alias("response"), F.regexp_replace(F.substr(title, F.length(head) + 1), r"(?U)^\s+", "").alias("subject"))


def subjects_equivalent(x: Column, y: Column) -> Column:
    """Word lists: equal, or the shorter has four words, three quarters of the longer, and begins or ends it."""
    short, long = F.when(F.size(x) < F.size(y), x).otherwise(y), F.when(F.size(x) < F.size(y), y).otherwise(x)
    n = F.greatest(F.size(short), F.lit(1))
    ends = (F.slice(long, 1, n) == short) | (F.slice(long, F.greatest(F.size(long) - F.size(short) + 1, F.lit(1)), n) == short)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((x == y) | ((F.size(short) >= 4) & (F.size(short) * 4 >= F.size(long) * 3) & ends))


def title_subject(title: Column) -> Column:
    """Words that name a title's subject: without the site's name at the end and without stop words."""
    cut = title
    for separator in (r" \| ", " — ", " - "):
        cut = F.regexp_replace(cut, rf"(?s)^(.*){separator}.*$", "$1")
    found = F.array_distinct(F.filter(tokens(cut), lambda w: (F.octet_length(w) >= 2) & ~w.isin(fixed.TITLE_STOP)))
    return F.when(title.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S"), F.array().cast("array<string>")).otherwise(found)


def identity_terms(x: Column) -> Column:
    return F.array_distinct(F.filter(tokens(x), lambda w: (F.octet_length(w) >= 3) & ~w.isin(fixed.IDENTITY_STOP)))


def identity_matches(name: Column, terms: Column) -> Column:
    """Are all parts of a name (but crate and rs) among the terms?"""
    parts = F.filter(F.split(name, NOT_WORD), lambda p: (F.octet_length(p) >= 2) & ~p.isin("crate", "rs"))
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.array_contains(terms, ascii_lower(p)))


def distinctive_tokens(query: Column) -> Column:
    return F.filter(tokens(query), lambda t: (F.octet_length(t) >= 3) & ~is_digits(t) & ~t.isin(fixed.DISTINCTIVE_STOP))


def brand(token: Column) -> Column:
    """A token without digits at its end, if three bytes stay."""
    stem = F.regexp_replace(token, "[0-9]+$", "")
    return F.when(F.octet_length(stem) >= 3, stem).otherwise(token)


def engines(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda e: ascii_lower(strip(e))), lambda e: e != ""))


def map_details(address: Column, hours: Column) -> Column:
    """``Address: 1 Road, Town, 123, Land. Hours: ...`` from a struct and opening hours."""
    blank = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    street = F.nullif(F.concat_ws(" ", blank(address["house_number"]), blank(address["road"])), F.lit(""))
    where = F.nullif(F.concat_ws(", ", street, blank(address["locality"]), blank(address["postcode"]), blank(address["country"])), F.lit(""))
    parts = F.concat_ws(". ", F.concat(F.lit("Address: "), where), F.concat(F.lit("Hours: "), blank(hours)))
    return F.nullif(parts, F.lit(""))


def markdown_links(md: Column) -> Column:
    """(label, url) of web links, in order."""
    pattern = r"\[([^\[\]]*)\]\(\s*<?(https?://[^)\s>]*)"
    return F.arrays_zip(F.regexp_extract_all(md, F.lit(pattern), 1).alias("label"), F.regexp_extract_all(md, F.lit(pattern), 2).alias("url"))


def recovered_title(content: Column, fallback: Column) -> Column:
    """The first ``Subject:`` of 80 lines, else the first heading of 20, if not too long."""
    lines = F.split(content, "\n")
    subject = F.get(F.filter(F.slice(lines, 1, 80), lambda x: strip(x).rlike(r"^Subject:\s*\S")), 0)
    heading = F.get(F.filter(F.slice(lines, 1, 20), lambda x: strip(x).rlike(r"^#+\s*\S")), 0)
    found = F.coalesce(strip(F.regexp_replace(strip(subject), "^Subject:", "")), strip(F.regexp_replace(strip(heading), "^#+", "")))
    return F.when(F.length(found) <= 200, found).otherwise(fallback)


def retry_after(message: Column) -> Column:
    return F.regexp_extract(message, r"more requests available in ([0-9]+)", 1).try_cast("bigint")


def cache_key(query: Column) -> Column:
    """Collapsed white space; lower-cased unless a token's case carries meaning."""
    flat = collapse(query)
    ts = F.filter(F.split(flat, r"[^\p{IsAlphabetic}\p{N}_:]+"), lambda t: t != "")
    upper = lambda t: F.length(F.regexp_replace(t, "[^A-Z]", ""))
    keeps = F.exists(ts, lambda t: t.isin([i.upper() for i in fixed.ISSUERS]) | t.contains("_") | t.contains("::") | ((upper(t) >= 2) & t.rlike("[a-z]")))
    return F.when(keeps, flat).otherwise(ascii_lower(flat))


def shingles(x: Column) -> Column:
    """Distinct runs of five words (Unicode lower case), null for texts with fewer than 44 words or 40 runs."""
    n = fixed.SHINGLE_WORDS
    enough = fixed.LEAST_SHINGLES + n - 1

    def of(ws: Column) -> Column:
        at = F.when(F.size(ws) >= enough, F.sequence(F.lit(1), F.size(ws) - n + 1))
        return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(ws, i + (k - 1)) for k in range(n)])))

    runs = let(F.filter(F.split(F.lower(x), NOT_WORD), lambda w: w != ""), of)
    return let(runs, lambda r: F.when(F.size(r) >= fixed.LEAST_SHINGLES, r))


def alphanumerics(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}]", ""))
