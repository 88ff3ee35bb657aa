"""What a query asks for: boolean Columns over query strings, and small text rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.text import let, NOT_WORD, ascii_lower, has_any, pairs, split_space, strip, tokens, words_of

EDGE = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def bare(word: Column) -> Column:
    """A word without punctuation around it."""
    return F.regexp_replace(word, EDGE, "")


def contains_any(x: Column, phrases) -> Column:
    return F.exists(words_of(phrases), lambda p: F.contains(x, p))


def has_token(query: Column, token: str) -> Column:
    return F.array_contains(tokens(query), token)


def strict_code(query: Column) -> Column:
    """First compiler code such as E0502 or TS2345, else null."""
    prefixes = "|".join(fixed.ERROR_CODE_PREFIXES)
    return F.nullif(F.regexp_extract(query, rf"(?<![\p{{IsAlphabetic}}\p{{N}}])((?:{prefixes})[0-9]{{3,5}})(?![\p{{IsAlphabetic}}\p{{N}}])", 1), F.lit(""))


def loose_code(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, r"(?<![\p{IsAlphabetic}\p{N}])([A-Za-z]{1,4}[0-9]{3,5})(?![\p{IsAlphabetic}\p{N}])", 1), F.lit(""))


def quoted_phrase(query: Column) -> Column:
    """First phrase in double quotes, if it has four characters or more."""
    phrase = strip(F.regexp_extract(query, r'"([^"]*)"', 1))
    return F.when(F.length(phrase) >= 4, phrase)


def quoted_diagnostic(query: Column) -> Column:
    """First quoted phrase that reads like a message of a program."""

    def good(phrase: Column) -> Column:
        ts = tokens(phrase)
        return (F.size(ts) >= 3) & (has_any(ts, fixed.DIAGNOSTIC_MARKERS) | contains_any(ascii_lower(phrase), fixed.NOT_DIAGNOSTICS))

    return F.get(F.filter(F.regexp_extract_all(query, F.lit(r'"([^"]*)"'), 1), good), 0)


def compact(diagnostic: Column, context: Column) -> Column:
    """A quoted diagnostic and up to eight telling words of its context."""
    edge = r"^[^\p{IsAlphabetic}\p{N}_:.+#-]+|[^\p{IsAlphabetic}\p{N}_:.+#-]+$"
    ws = F.transform(context, lambda w: F.regexp_replace(w, edge, ""))
    ws = F.slice(F.filter(ws, lambda w: w.rlike(r"[\p{IsAlphabetic}\p{N}]") & ~ascii_lower(w).isin(fixed.DIAGNOSTIC_STOP)), 1, 8)
    return F.concat(F.lit('"'), diagnostic, F.lit('"'), F.when(F.size(ws) > 0, F.concat(F.lit(" "), F.array_join(ws, " "))).otherwise(""))


def exact_identifier(query: Column) -> Column:
    """A query for an exact name: a quoted diagnostic, a compiler code, or a name with ``_`` or ``::``; else null."""
    diagnostic = quoted_diagnostic(query)
    quoted = F.concat(F.lit('"'), diagnostic, F.lit('"'))
    around = split_space(F.substr(query, F.lit(1), F.instr(query, quoted) - 1))
    around = F.concat(around, split_space(F.substr(query, F.instr(query, quoted) + F.length(quoted))))
    code = strict_code(query)
    ws = split_space(query)
    names = F.transform(ws, lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}_:]+|[^\p{IsAlphabetic}\p{N}_:]+$", ""))
    is_name = lambda w: w.rlike("_|::") & (F.length(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", "")) >= 2)
    name = F.get(F.filter(names, is_name), 0)
    at = F.array_position(names, name).cast("int")
    near = F.concat(F.slice(ws, at + 1, F.size(ws)), F.reverse(F.slice(ws, F.lit(1), F.greatest(at - 1, F.lit(0)))))
    useful = F.filter(F.transform(near, bare), lambda w: (F.octet_length(w) >= 3) & ~ascii_lower(w).isin(fixed.COMPANION_STOP))
    companion = F.when(~name.contains("::"), F.get(useful, 0))
    named = F.concat(F.lit('"'), name, F.lit('"'), F.coalesce(F.concat(F.lit(" "), companion), F.lit("")))
    return F.when(diagnostic.isNotNull(), compact(diagnostic, around)).when(code.isNotNull(), compact(code, F.filter(ws, lambda w: bare(w) != code))).when(name.isNotNull(), named)


def it(query: Column) -> Column:
    ts = tokens(query)
    strong = has_any(ts, fixed.STRONG_BRANDS) | contains_any(ascii_lower(query), fixed.BRAND_SPELLINGS)
    # A token with a lower-case letter, and a capital after its first character.
    cased = F.exists(F.split(query, NOT_WORD), lambda t: t.rlike("[a-z]") & F.substr(t, F.lit(2)).rlike("[A-Z]"))
    shape = query.contains("::") | query.contains("_") | cased
    return exact_identifier(query).isNotNull() | strong | (has_any(ts, fixed.AMBIGUOUS_BRANDS) & (has_any(ts, fixed.TECHNICAL_CONTEXT) | shape))


def scholarly(query: Column) -> Column:
    return has_any(tokens(query), fixed.SCHOLARLY_WORDS)


def science(query: Column) -> Column:
    ts = tokens(query)
    explicit = has_any(ts, fixed.EXPLICIT_SCHOLARLY) | has_any(pairs(ts), fixed.SCHOLARLY_PAIRS)
    cue = has_any(ts, fixed.SCHOLARLY_WORDS) | has_any(ts, fixed.RESEARCH_CUES)
    return explicit | has_any(ts, fixed.DISTINCTIVE_SUBJECTS) | (has_any(ts, fixed.BROAD_SUBJECTS) & cue)


def fresh(query: Column) -> Column:
    return has_any(tokens(query), fixed.FRESHNESS)


def news(query: Column) -> Column:
    ts = tokens(query)
    return F.when(has_any(ts, fixed.EXPLICIT_NEWS), fresh(query) | ~it(query)).otherwise(fresh(query) & has_any(ts, fixed.EVENTS))


def freshness_window(query: Column) -> Column:
    return F.when(fresh(query), "year")


def category(configured: Column, name: str) -> Column:
    return F.array_contains(F.transform(F.split(configured, ","), strip), name)


def full_text(query: Column) -> Column:
    """``full text`` asked for as content: not where a feature such as ``full text search`` is meant."""
    ts = F.array_join(tokens(query), " ")
    return F.concat(F.lit(" "), ts, F.lit(" ")).rlike(rf" (?:fulltext|full text) (?!(?:{'|'.join(fixed.FULL_TEXT_FEATURES)}) )")


def strict_source(query: Column) -> Column:
    low, ts = ascii_lower(query), tokens(query)
    original = F.array_contains(ts, "original") & has_any(ts, ["disclosure", "paper"])
    return has_any(ts, ["arxiv", "official"]) | full_text(low) | original | contains_any(low, fixed.STRICT_PHRASES)


def has_quoted_diagnostic(query: Column) -> Column:
    return quoted_phrase(query).isNotNull() & (loose_code(query).isNotNull() | has_any(tokens(query), fixed.DIAGNOSTIC_WORDS))


def case_study(query: Column) -> Column:
    return query.rlike("(?i)case stud(y|ies)")


def numerical_parity(query: Column) -> Column:
    ts = tokens(query)
    return F.array_contains(ts, "cpu") & F.array_contains(ts, "cuda") & has_any(ts, ["drift", "reproducibility"]) & has_any(ts, ["numerical", "tolerance"])


def research(query: Column) -> Column:
    ts = tokens(query)
    return has_any(ts, fixed.RESEARCH_WORDS) | (~case_study(query) & has_any(ts, ["study", "studies"]))


def as_of(query: Column) -> Column:
    return fresh(query) | has_any(pairs(tokens(query)), ["as of"])


def recency(query: Column) -> Column:
    ts = tokens(query)
    return has_any(ts, fixed.RECENCY) | (F.array_contains(ts, "current") & has_any(ts, fixed.TEMPORAL_NOUNS))


def auxiliary(query: Column) -> Column:
    """May side sources be asked?"""
    return ~strict_source(query)


def is_arxiv(token: Column) -> Column:
    return token.rlike(r"^[0-9]{4}\.[0-9]{4,}$")


def is_cve(token: Column) -> Column:
    return token.rlike(r"(?i)^cve-[0-9]{4}-[0-9]{4,}$")


def issuer(query: Column) -> Column:
    """First known issuing body that a query names, in capitals."""
    return F.upper(F.get(F.filter(tokens(query), lambda t: t.isin(list(fixed.ISSUERS))), 0))


def normalized_modifiers(query: Column) -> Column:
    """A query without question words and modifiers; as it is if nothing else is left."""
    kept = F.array_join(F.filter(split_space(query), lambda w: ~ascii_lower(bare(w)).isin(fixed.MODIFIERS)), " ")
    return let(kept, lambda k: F.when(k == "", query).otherwise(k))


def is_day(word: Column) -> Column:
    n = F.regexp_extract(ascii_lower(bare(word)), r"^([0-9]{1,2})(?:st|nd|rd|th)?$", 1)
    return F.coalesce(n.try_cast("int").between(1, 31), F.lit(False))


def is_year_word(word: Column) -> Column:
    return F.coalesce(F.regexp_extract(bare(word), "^([0-9]{4})$", 1).try_cast("int").between(fixed.FIRST_YEAR, fixed.LAST_YEAR), F.lit(False))


def normalized_news(query: Column) -> Column:
    """A query without news words and dates (a month before a day or year, or after ``in``, ``since`` and the like).

    A fold over the words; ``skip`` is 2 after a dropped month (a day or a year may follow), 1 after a day."""
    return let(let(split_space(query), without_dates), lambda kept: F.when(kept == "", query).otherwise(kept))


def without_dates(ws: Column) -> Column:
    """``normalized_news`` of words, which are bound to a name; empty if none is left."""
    low = F.transform(ws, lambda w: ascii_lower(bare(w)))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def kept(words: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            w, after, before = F.get(words["low"], i), F.get(words["low"], i + 1), F.get(words["low"], i - 1)
            day, year = (acc["skip"] == 2) & is_day(w), (acc["skip"] >= 1) & is_year_word(w)
            dated = F.coalesce(is_day(after) | is_year_word(after), F.lit(False)) | F.coalesce((i > 0) & before.isin(fixed.DATE_INTRODUCTIONS), F.lit(False))
            month = w.isin(list(fixed.MONTHS)) & dated
            out = lambda skip, x: F.struct(F.lit(skip).alias("skip"), x.alias("out"))
            return F.when(day, out(1, acc["out"])).when(year, out(0, acc["out"])).when(month, out(2, acc["out"])).when(w.isin(fixed.NEWS_DROPPED), out(0, acc["out"])).otherwise(out(0, F.concat(acc["out"], F.array(F.get(words["ws"], i)))))

        at = F.when(F.size(words["ws"]) > 0, F.sequence(F.lit(0), F.size(words["ws"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.aggregate(at, start, step)["out"], " ")

    return let(F.struct(ws.alias("ws"), low.alias("low")), kept)


def paper_title(query: Column) -> Column:
    """The title in a request for a paper (``original paper``, or ``arxiv`` and ``paper`` unless exploring), if three words remain."""
    ts = tokens(query)
    known = F.array_contains(ts, "arxiv") & F.array_contains(ts, "paper") & ~has_any(ts, fixed.EXPLORATORY)
    kept = F.filter(split_space(query), lambda w: ~ascii_lower(bare(w)).isin(fixed.PAPER_MARKERS))
    return F.when((ascii_lower(query).contains("original paper") | known) & (F.size(kept) >= 3), F.array_join(kept, " "))


def bare_words(query: Column) -> Column:
    return F.transform(split_space(ascii_lower(query)), bare)


def source(query: Column) -> Column:
    """Is a source itself asked for?"""
    low = ascii_lower(query)
    return has_any(tokens(query), ["arxiv"]) | full_text(low) | contains_any(low, ["original paper", "primary source", "release notes"]) | has_any(bare_words(query), fixed.SOURCE_WORDS)


def documentation(query: Column) -> Column:
    return has_any(bare_words(query), fixed.DOCUMENTATION_WORDS)


def reserves_authority(query: Column, named: Column) -> Column:
    """Does the named source keep a place: a kind of document is asked for, and no diagnostic?"""
    return named.isNotNull() & ~has_quoted_diagnostic(query) & has_any(tokens(query), fixed.AUTHORITY_DOCUMENTS)


def asks_questions(query: Column) -> Column:
    """Is the question-and-answer network worth asking?"""
    return it(query) & (exact_identifier(query).isNotNull() | quoted_phrase(query).isNotNull() | has_any(tokens(query), fixed.QUESTION_ERRORS))


def issue_query(query: Column) -> Column:
    """What to ask an issue tracker: the exact name, or fixed words for numerical parity."""
    return F.coalesce(exact_identifier(query), F.when(numerical_parity(query), "cpu cuda numerical tolerance"))


def percent_context(query: Column) -> Column:
    """(relations, topics) of a query about a percentage, else null."""
    ts = F.array_distinct(tokens(query))
    asks = has_any(ts, ["percent", "percentage"]) | query.contains("%") | has_any(ts, fixed.PERCENT_MEASURES)
    found = [F.when(has_any(ts, k.split()), words_of(v.split())).otherwise(F.array().cast("array<string>")) for k, v in fixed.RELATIONS.items()]
    topics = F.filter(ts, lambda t: (F.octet_length(t) > 2) & ~t.rlike("^[0-9]+$") & ~t.isin(fixed.NUMERIC_TOPIC_STOP))
    return F.when(asks, F.struct(F.array_distinct(F.concat(*found)).alias("relations"), topics.alias("topics")))


def percentages(x: Column, relations: Column, topics: Column) -> Column:
    """Distinct percentages (times 1000, whole) near a relation (six words) and a topic (fourteen words)."""
    return let(F.struct(split_space(x).alias("words"), relations.alias("relations"), topics.alias("topics")), stated)


def stated(given: Column) -> Column:
    """``percentages`` of words, with what is computed once bound to a name."""
    ws, relations, topics = given["words"], given["relations"], given["topics"]
    around = lambda i, n: F.flatten(F.transform(F.slice(ws, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)) + n + 1), tokens))

    def fact(i: Column) -> Column:
        w = F.get(ws, i)
        number = F.regexp_extract(w, r"([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)%", 1)
        spelled = F.when(ascii_lower(bare(F.get(ws, i + 1))).isin("percent", "percentage"), F.regexp_extract(w, r"^[^0-9+-]*([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)[^0-9%]*$", 1))
        value = F.coalesce(F.nullif(number, F.lit("")), F.nullif(spelled, F.lit("")))
        v = F.replace(value, F.lit(","), F.lit("")).try_cast("double")
        near, wide = around(i, 6), around(i, 14)
        related = (F.size(relations) == 0) | F.arrays_overlap(near, relations)
        topical = (F.size(topics) == 0) | F.arrays_overlap(wide, topics)
        deposit = F.array_contains(near, "down") & F.array_contains(near, "payment") & ~F.array_contains(topics, "payment")
        return F.when(v.isNotNull() & (F.abs(v) <= 100), F.when(related & topical & ~deposit, F.round(v * 1000).cast("int")))

    at = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.filter(at, lambda i: F.get(ws, i).rlike("[0-9]"))
    return F.array_distinct(F.filter(F.transform(numbers, fact), lambda f: f.isNotNull()))
