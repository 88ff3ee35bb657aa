"""Comparing a requested title with titles of results; their form as a case study."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.intent import case_study, full_text, paper_title
from millrace.functions.text import ascii_lower, identity_terms, is_digits, pairs, split_space, strip, tokens, words_of

#: A tag in brackets that describes the file, not the work: pdf, arxiv..., or anything with a digit or dot.
TAG = r"\[(?:(?i:pdf)|(?i:arxiv)[^\]]*|[^\]]*[0-9.][^\]]*)\]"


def normalized(title: Column) -> Column:
    """Words of a title, lower-cased, without tags, labels of the file kind and the site's name at its end."""
    x = F.regexp_replace(strip(title), rf"^(?:{TAG}\s*)+", "")
    pdf = F.regexp_replace(x, r"(?i)^pdf(?=[ :.-])[ :-]*", "")
    arxiv = F.regexp_replace(x, rf"(?i)^arxiv(?=[ :.-])[ :-]*(?:\.org[ :-]*)?(?:[0-9.]*[0-9][0-9.]*\s+)?(?:{TAG}\s*)*", "")
    y = F.when(pdf != x, pdf).otherwise(arxiv)
    low = ascii_lower(y)
    ends = F.filter(F.transform(words_of(fixed.TITLE_SITE_SUFFIXES), lambda s: F.position(s, low)), lambda p: p > 0)
    cut = F.when(F.size(ends) > 0, F.substr(y, F.lit(1), F.array_min(ends) - 1)).otherwise(y)
    return F.array_join(tokens(cut), " ")


def equivalent(expected: Column, candidate: Column) -> Column:
    """Equal; or the candidate is cut short (four words, two thirds), or only adds digits and words of archives."""
    e, c = normalized(expected), normalized(candidate)
    x, y = split_space(e), split_space(c)
    n, m = F.size(x), F.size(y)
    short = (m >= 4) & (m < n) & (F.slice(x, F.lit(1), F.greatest(m, F.lit(1))) == y) & (m * 3 >= n * 2)
    tail = F.slice(y, n + 1, F.greatest(m, F.lit(1)))
    long = (m > n) & (F.when(n > 0, F.slice(y, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(x) == x) & F.forall(tail, lambda w: is_digits(w) | w.isin(fixed.TITLE_TAIL))
    return (e == c) | short | long


def requested(query: Column) -> Column:
    """The title that a query asks for: of a paper, or of a full text; null if it names none."""
    first = F.regexp_replace(query, r"(?i)^(.*?)full[ -]text", "$1")
    bare = F.regexp_replace(first, r"""(?U)^[\s:"'-]+|[\s:"'-]+$""", "")
    bare = F.regexp_replace(bare, "(?i)^of ", "")
    return F.coalesce(paper_title(query), F.when(full_text(query) & query.rlike("(?i)full[ -]text") & (F.size(split_space(normalized(bare))) >= 2), bare))


def has_case_study_form(title: Column) -> Column:
    ts = tokens(title)
    labelled = F.arrays_overlap(pairs(ts), words_of(["case study", "case studies"]))
    adopts = F.exists(ts, lambda t: t.startswith("adopt") | t.startswith("migrat"))
    return labelled | (adopts & F.arrays_overlap(ts, words_of(["experience", "journey", "lessons"])))


def case_study_adjustment(query: Column, title: Column) -> Column:
    """Bonus of a case study whose title names a subject of the query."""
    entities = F.filter(identity_terms(query), lambda t: ~t.isin(fixed.CASE_STUDY_GENERIC))
    good = case_study(query) & has_case_study_form(title) & F.arrays_overlap(entities, tokens(title))
    return F.when(F.coalesce(good, F.lit(False)), fixed.CASE_STUDY_WEIGHT).otherwise(0.0)
