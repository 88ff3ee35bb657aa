"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser streams events; each block-level boundary ends a line.  A line has its
text and the number of tags seen in it; its text-to-tag ratio is smoothed along the page with a Gaussian
kernel, and two clusters of the smoothed ratios (content and the rest, split by iterated means) select
the content lines of the page.  They alone decide where the article is:

* if elements that are marked as articles hold a ``MARKED`` share of the content lines' text, the regions are those
  that hold content lines (teasers without any do not count);
* else it is the smallest container that holds a ``HELD`` share of it;
* else the regions are runs of lines of prose around content lines, and what lies between the first and last of these.

A region's lines of prose are its text: headings and short paragraphs belong to it, lines that are mostly links do not
unless they are content lines.  Lines inside elements whose tags, roles or names say that they are no article text
(navigation, headers, footers, asides, forms, notices, adverts, comments) do not count, unless the element is what the
page is about: what a ``WRAPS`` share of the page's prose stands in is a layout or a form around it, whatever its name.
A name is a whole word of a class or an id: all its parts are ``NAMES`` or ``PLAIN`` words, so "site-footer" is one and
"with-sidebar", "social-science" and "legal-news" are none.

Defined cases: null and empty pages, pages without text and pages with boilerplate only give an empty
text; where all ratios are equal all lines are content; unclosed and stray tags are tolerated; very long lines are
kept whole; repeated rows give repeated results; null ids and URLs are passed on; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page, and elements whose text is no article.
SILENT = frozenset("script style head title noscript template svg math iframe object select textarea button canvas audio video".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words of classes and ids of boilerplate, words that may stand beside them in one name, and names of reader comments.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead share sharing social related recommended comment comments disqus replies respond pagination pager toolbar copyright legal".split()
)
PLAIN = frozenset("area bar block body bottom box buttons container content form global group header holder icons inner items left links list main message outer page panel posts primary right row secondary section signup site slot stories text thread title top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: Share of the page's prose that makes a named element a wrapper, and lines of prose that it needs without a mark.
WRAPS, WRAPPED = 0.5, 3
FIXED, NAMED, REPLIES = range(3)
#: The paragraphs and list items that an unclosed one of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA, ROUNDS = 1.0, 20
#: Shares of the content lines' text that marked articles, or else a container, must hold.
MARKED, HELD = 0.25, 0.75
CONTAINERS = frozenset("article center div main section td".split())
SPACE, PARTS = re.compile(r"\s+"), re.compile(r"[-_:]+|(?<=[a-z])\d+$")


class Lines(HTMLParser):
    """Collects lines as [text, tags, characters in links, number of the innermost article (or 0), numbers of the asides, numbers of the containers].

    ``asides`` has of each element that may be boilerplate its kind, and whether an article and whether a main heading begin in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.stack: list[tuple[str, int, bool, bool, bool, bool]] = []  # name, silent, aside, article, link, container
        self.silent = self.link = self.count = 0
        self.asides: list[list] = []
        self.inside: tuple[int, ...] = ()
        self.articles: list[int] = []
        self.containers: tuple[int, ...] = ()

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append([text, self.tags, self.linked, self.articles[-1] if self.articles else 0, self.inside, self.containers])
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in CLOSES and self.stack and self.stack[-1][0] in CLOSES[tag]:
            self.pop(len(self.stack) - 1)
        if tag in VOID:
            return
        named = dict(attrs) if attrs else {}
        kind = FIXED if tag in ASIDE or tag == "header" and not self.articles else NAMED if tag == "form" else None
        if named and kind is None and tag not in ("html", "body", "article", "main"):
            kind = self.judged(named)
        self.silent += tag in SILENT
        # A comment may be marked up as an article inside the article: it stays part of its boilerplate.
        article = tag in ("article", "main") or named.get("itemprop") == "articleBody" or (named.get("role") or "") in ("main", "article")
        for i in self.inside:
            self.asides[i][1] |= article
            self.asides[i][2] |= tag in ("h1", "main")
        if kind is not None:
            self.inside += (len(self.asides),)
            self.asides.append([kind, False, False])
        aside = kind is not None
        container = article or tag in CONTAINERS
        if container:
            self.count += 1
            self.containers += (self.count,)
        if article:
            self.articles.append(self.count)
        self.link += tag == "a"
        self.stack.append((tag, tag in SILENT, aside, article, tag == "a", container))

    @staticmethod
    def judged(named: dict) -> int | None:
        """What an element's attributes say: boilerplate for sure, by its name, by the name of comments, or nothing."""
        if "hidden" in named or named.get("aria-hidden") == "true":
            return FIXED
        if (named.get("role") or "").lower() in ROLES:
            return FIXED
        for word in f"{named.get('class') or ''} {named.get('id') or ''}".lower().split():
            parts = [x for x in PARTS.split(word) if x]
            names = NAMES.intersection(parts)
            if names and NAMES.union(PLAIN).issuperset(parts):
                return REPLIES if names & COMMENTS else NAMED
        return None

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def pop(self, at: int) -> None:
        for _, silent, aside, article, link, container in reversed(self.stack[at:]):
            self.silent -= silent
            if aside:
                self.inside = self.inside[:-1]
            self.link -= link
            if article:
                self.articles.pop()
            if container:
                self.containers = self.containers[:-1]
        del self.stack[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.pop(at)
                return
            if self.stack[at][0] in ("article", "body", "td") and tag not in ("article", "body", "html", "table", "tr", "td"):
                return  # a stray end tag does not leave its region

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is renormalised."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[r : r + len(x)] / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def threshold(x: np.ndarray) -> float:
    """The value midway between the means of two clusters on a line, by iterated means."""
    at = float(x.mean())
    for _ in range(ROUNDS):
        low, high = x[x <= at], x[x > at]
        if not len(low) or not len(high):
            return at
        new = float(low.mean() + high.mean()) / 2
        if new == at:
            break
        at = new
    return at


def content(ratio: np.ndarray) -> np.ndarray:
    """Which lines are content by their text-to-tag ratios."""
    ratio = smoothed(ratio)
    return ratio >= threshold(ratio) - 1e-9


def container(paths: list[tuple[int, ...]], mass: np.ndarray) -> int:
    """The innermost container that holds a ``HELD`` share of the mass, 0 if there is none."""
    best, depth, need = 0, 0, HELD * mass.sum()
    while True:
        held: dict[int, int] = {}
        for path, m in zip(paths, mass.tolist(), strict=True):
            if len(path) > depth and (not depth or path[depth - 1] == best):
                held[path[depth]] = held.get(path[depth], 0) + m
        inner = max(held, key=held.get, default=0)
        if not inner or held[inner] < need:
            return best
        best, depth = inner, depth + 1


def grown(seeds: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Runs of prose that contain seeds, and the prose between the first and last seed."""
    run = np.cumsum(~prose)
    out = prose & np.isin(run, run[seeds & prose])
    at = np.flatnonzero(seeds)
    out[at[0] : at[-1] + 1] |= prose[at[0] : at[-1] + 1]
    return out


def boilerplate(parser: Lines) -> set[int]:
    """Numbers of the elements that are boilerplate; those that wrap most of the page's prose are not.

    Tags, roles and comments are judged by the whole page; what remains is what names are judged by, so that long
    comments beside a layout do not make it small.  An element needs a mark of content in it: an article or a main
    heading (for comments and fixed ones a main heading), or, for names only, some lines of prose."""
    rows = [(x[4], len(x[0]) - x[2]) for x in parser.lines if 2 * x[2] < len(x[0])]
    out = set(range(len(parser.asides)))
    for kinds in ((FIXED, REPLIES), (NAMED,)):
        others = {i for i in out if parser.asides[i][0] not in kinds} if kinds == (NAMED,) else set()
        mass, count, total = [0] * len(parser.asides), [0] * len(parser.asides), 0
        for inside, m in rows:
            if others.isdisjoint(inside):
                total += m
                for i in inside:
                    mass[i] += m
                    count[i] += 1
        for i, (kind, article, heading) in enumerate(parser.asides):
            marked = heading or kind == NAMED and (article or count[i] >= WRAPPED)
            if kind in kinds and marked and mass[i] >= max(1, WRAPS * total):
                out.discard(i)
    return out


def main_text(html: str | None) -> str:
    """The text of a page's article, blocks joined by one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    drop = boilerplate(parser) if parser.asides else set()
    lines = [x for x in parser.lines if drop.isdisjoint(x[4])]
    if not lines:
        return ""
    size, linked, article = (np.array([f(x) for x in lines]) for f in (lambda x: len(x[0]), lambda x: x[2], lambda x: x[3]))
    prose = 2 * linked < size
    seeds = content((size - linked) / np.maximum(1, [x[1] for x in lines]))
    mass = np.where(seeds, size - linked, 0)
    if mass[article > 0].sum() >= max(1, MARKED * mass.sum()):
        keep = np.isin(article, article[seeds & (article > 0)]) & (seeds | prose)
    elif region := container([x[5] for x in lines], mass):
        keep = np.array([region in x[5] for x in lines]) & (seeds | prose)
    else:
        keep = seeds & prose | grown(seeds, prose)
    return " ".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(common.tidy(run), "page_id long, url string, text string, n_chars long")


def op6_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    common.prepare(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
