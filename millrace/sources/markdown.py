"""Readable content of HTML pages as Markdown.

The standard library's events build a tree (:class:`Tree`), flat lists in document order: a node's parent comes before it,
so sums over subtrees are one loop backwards.  Every block of text gives points to the elements around it, and the
element with the most points and the fewest links is the content (:func:`chosen`); forum pages of the known kind are cut to
their title and posts first (:func:`focused`).  What is chosen is written as Markdown: headings, paragraphs, nested
lists, tables, quotes, code, links and emphasis.

Unclosed and stray tags are tolerated; null or empty pages have no content; nothing is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without readable text, elements that are no content, words of class names that say so.
SILENT = frozenset("script style head title noscript template svg math iframe object select textarea button canvas audio video".split())
ASIDE = frozenset("nav footer aside menu dialog form".split())
UNLIKELY = frozenset("ad ads advert banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer menu nav navbar newsletter pager pagination popup promo related replies share sharing sidebar social sponsor toolbar widget".split())
#: What an end tag of a parent or a new sibling closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: Blocks that score, the least length of their text, and what their ancestors get of the points by distance.
SCORED, LEAST, SHARES = frozenset("p pre blockquote li td dd".split()), 25, (1.0, 0.5, 1 / 3)
#: A sibling of the content belongs to it from this share of its points on; content of less than ``HELD`` of the text is no choice.
SIBLING, HELD = 0.2, 0.25
POST, TOPIC = "crawler-post", "topic-title"
SPACE, COMMA = re.compile(r"[ \t\n\r\f]+"), re.compile(r"[,،、，]")


class Tree(HTMLParser):
    """Nodes in document order: ``tag`` ("" for text), ``parent``, ``text`` or attributes, ``last`` (the end of the subtree)."""

    def __init__(self, html: str, noscript: bool = False):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.text, self.attrs = ["body"], [-1], [""], [{}]
        self.open, self.silent = [0], SILENT - {"noscript"} if noscript else SILENT
        self.muted = 0
        self.feed(html)
        self.close()
        self.last = list(range(1, len(self.tag) + 1))
        for i in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])

    def node(self, tag: str, text: str = "", attrs: dict | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.text.append(text)
        self.attrs.append(attrs or {})
        return len(self.tag) - 1

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.muted or tag in self.silent:
            self.muted += tag in self.silent and tag not in VOID
            return
        if tag in ("html", "body"):
            return
        if tag in ENDS_P and len(self.open) > 1 and self.tag[self.open[-1]] == "p":
            self.open.pop()
        if tag in CLOSES:
            for k in range(len(self.open) - 1, 0, -1):
                if (name := self.tag[self.open[k]]) in CLOSES[tag]:
                    del self.open[k:]
                    break
                if name in BLOCKS:
                    break
        i = self.node(tag, attrs={k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(i)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.muted:
            self.muted -= tag in self.silent
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[k]]
            if name == tag:
                del self.open[k:]
                return
            if name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return  # a stray end tag does not leave its cell

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.node("", data)


def words_of(tree: Tree, i: int) -> list[str]:
    """Whole words of a node's class and id, of parts joined by hyphens the first and the last."""
    out = []
    for word in f"{tree.attrs[i].get('class', '')} {tree.attrs[i].get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", word)
        out += [word, parts[-1]] if parts[0] not in ("no", "with", "has", "without") else []
    return out


def measured(tree: Tree) -> tuple[list[int], list[int], list[float]]:
    """(length of text, length of text in links, points) of every subtree.

    Lengths do not count white space; points are of blocks below, by distance."""
    n = len(tree.tag)
    size, linked, own, points = [0] * n, [0] * n, [0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        p = tree.parent[i]
        if not tree.tag[i]:
            size[i] = len(SPACE.sub("", tree.text[i]))
            own[i] = len(COMMA.findall(tree.text[i]))
        elif tree.tag[i] == "a":
            linked[i] = size[i]
        if p >= 0:
            size[p] += size[i]
            linked[p] += linked[i]
            if tree.tag[i] not in BLOCKS:
                own[p] += own[i]
        if tree.tag[i] in SCORED and size[i] >= LEAST:
            worth = 1 + own[i] + min(size[i] / 100, 3)
            for share in SHARES:
                if p < 0:
                    break
                points[p] += share * worth
                p = tree.parent[p]
    return size, linked, points


def article(tree: Tree, size: list[int]) -> int:
    """The only article of a page that has text, else the only main element, else 0."""
    for tag in ("article", "main"):
        found = [i for i, t in enumerate(tree.tag) if t == tag and size[i]]
        if len(found) == 1:
            return found[0]
    return 0


def dropped(tree: Tree, size: list[int]) -> list[bool]:
    """Subtrees that are no content by tag, role or name, unless they hold most of the page's text and no article is beside them."""
    out = [False] * len(tree.tag)
    own = article(tree, size)
    for i in range(1, len(tree.tag)):
        named = tree.tag[i] in ASIDE or "hidden" in tree.attrs[i] or tree.attrs[i].get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
        named = named or bool(tree.attrs[i]) and tree.tag[i] not in ("article", "main") and not UNLIKELY.isdisjoint(words_of(tree, i))
        beside = own and not i <= own < tree.last[i]
        out[i] = out[tree.parent[i]] or bool(named and (beside or 2 * size[i] < size[0]))
    return out


def chosen(tree: Tree) -> tuple[list[int], list[bool]]:
    """(roots of the content, in order; dropped subtrees)."""
    size, linked, points = measured(tree)
    drop = dropped(tree, size)
    score = [p * (1 - linked[i] / size[i]) if size[i] and not drop[i] else 0.0 for i, p in enumerate(points)]
    top = max(range(len(score)), key=lambda i: (score[i], -i))
    if not score[top]:
        own = article(tree, size)
        return [0 if drop[own] else own], drop
    parent, roots = tree.parent[top], [top]
    if parent >= 0:
        limit = max(1.0, SIBLING * score[top])
        for i in range(parent + 1, tree.last[parent]):
            if tree.parent[i] == parent and i != top and not drop[i] and size[i]:
                beside = tree.tag[i] in ("p", "h1", "h2", "h3", "pre", "blockquote", "ul", "ol", "table") and 4 * linked[i] < size[i]
                if score[i] >= limit or beside:
                    roots.append(i)
    prose = [n - k for n, k in zip(size, linked, strict=True)]
    left = prose[0] - sum(prose[i] for i in range(1, len(size)) if drop[i] and not drop[tree.parent[i]])
    if sum(prose[i] for i in roots) < HELD * left:
        return [0], drop
    return sorted(roots), drop


def focused(html: str) -> Tree | None:
    """The tree of a forum page's title and posts, also where they stand in a noscript element; None for other pages."""
    if POST not in html or "Discourse" not in html:
        return None
    whole = Tree(html, noscript=True)
    of = lambda i: whole.attrs[i].get("class", "").split()
    above = [False] * len(whole.tag)
    keep = []
    for i in range(1, len(whole.tag)):
        p = whole.parent[i]
        above[i] = above[p] or POST in of(i)
        if "post" in of(i) and above[p] or whole.tag[i] == "h1" and any(whole.attrs[k].get("id") == TOPIC for k in ancestors(whole, i)):
            keep.append(i)
    if not any("post" in of(i) for i in keep):
        return None
    out = Tree("")
    out.node("article")
    at = {}
    for i in sorted(keep, key=lambda i: (whole.tag[i] != "h1", i)):
        if any(k in at for k in ancestors(whole, i)):
            continue
        for k in range(i, whole.last[i]):
            out.open = [1 if k == i else at[whole.parent[k]]]
            at[k] = out.node(whole.tag[k], whole.text[k], whole.attrs[k])
    out.last = list(range(1, len(out.tag) + 1))
    for i in range(len(out.tag) - 1, 0, -1):
        out.last[out.parent[i]] = max(out.last[out.parent[i]], out.last[i])
    return out


def ancestors(tree: Tree, i: int) -> Iterator[int]:
    while (i := tree.parent[i]) >= 0:
        yield i


class Sign(str):
    """The beginning of an inline element that is still open."""


SIGNS = {"b": Sign("**"), "strong": Sign("**"), "i": Sign("*"), "em": Sign("*"), "code": Sign("`"), "a": Sign("[")}


class Writer:
    """Markdown of subtrees: lines of the block that is open, and finished blocks.

    Elements are entered and left in document order, so depth costs no Python stack."""

    def __init__(self, tree: Tree, drop: list[bool], url: str):
        self.tree, self.drop, self.url = tree, drop, url
        self.out: list[str] = []
        self.line: list[str] = []
        self.gaps: list[str] = []
        self.items = False  # the last block is an item of the list that is open
        self.lists: list[list] = []
        self.mark, self.quote, self.pre = "", 0, 0
        self.rows: list[list[list[str]]] = []
        self.cell: list[list[str]] = []

    def flush(self) -> None:
        text = "".join(x for x in self.line if not isinstance(x, Sign))
        text = text.strip("\n") if self.pre else re.sub(" *\v *", "\n", SPACE.sub(" ", text)).strip()
        self.line = []
        if not text:
            return
        if self.cell:
            self.cell[-1].append(text.replace("\n", " ").replace("|", "\\|"))
            return
        quote = "> " * self.quote
        indent = "  " * max(0, len(self.lists) - 1)
        first = indent + self.mark
        rest = indent + " " * len(self.mark)
        if self.lists and not self.mark and not self.pre:
            first = rest = indent + "  "
        block = "\n".join(quote + (first if k == 0 else rest) + x for k, x in enumerate(text.split("\n")))
        self.out.append(block)
        self.gaps.append("\n" if self.lists and self.mark and self.items else "\n\n")
        self.items = bool(self.lists)
        self.mark = ""

    def enter(self, i: int) -> None:
        tag = self.tree.tag[i]
        if tag in BLOCKS:
            self.flush()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.mark = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol", "menu", "dir"):
            self.items &= bool(self.lists)
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            self.mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
        elif tag == "blockquote":
            self.quote += 1
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th") and self.rows:
            self.cell.append([])
        elif tag == "br":
            self.line.append("\n" if self.pre else "\v")
        elif tag == "hr":
            self.line.append("---")
            self.flush()
        elif not self.pre:
            self.line.append(SIGNS.get(tag, ""))

    def leave(self, i: int) -> None:
        tag = self.tree.tag[i]
        if tag in BLOCKS and tag != "pre":
            self.flush()
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists.pop()
        elif tag == "li" or tag[0] == "h" and tag[1:].isdigit():
            self.mark = ""
        elif tag == "blockquote":
            self.quote -= 1
        elif tag == "pre":
            text = "".join(self.line).strip("\n")
            self.line = []
            self.pre -= 1
            if text:
                fence = "```" if "```" not in text else "~~~"
                self.pre += 1
                self.line = [f"{fence}\n{text}\n{fence}"]
                self.flush()
                self.pre -= 1
        elif tag in ("td", "th") and self.rows and self.cell:
            text = " ".join(self.cell.pop())
            (self.rows[-1] or [[]])[-1].append(text)
            if not self.rows[-1]:
                self.rows[-1].append([text])
        elif tag == "table" and self.rows:
            self.table(self.rows.pop())
        elif not self.pre and tag in ("b", "strong", "i", "em", "code", "a"):
            self.close(i, tag)

    def close(self, i: int, tag: str) -> None:
        """End an inline element; what holds no text leaves nothing."""
        sign = SIGNS[tag]
        at = len(self.line) - 1
        while at >= 0 and not (isinstance(self.line[at], Sign) and self.line[at] == sign):
            at -= 1
        if at < 0:
            return  # a block began inside
        text = SPACE.sub(" ", "".join(x for x in self.line[at + 1 :] if not isinstance(x, Sign)))
        del self.line[at:]
        inner = text.strip()
        href = self.tree.attrs[i].get("href", "").strip() if tag == "a" else ""
        if inner and tag == "a":
            target = absolute(self.url, href)
            inner = f"[{inner}]({target})" if target else inner
        elif inner:
            inner = f"{sign}{inner}{sign}"
        self.line.append((" " if text[:1] == " " else "") + inner + (" " if text[-1:] == " " and inner else ""))

    def table(self, rows: list[list[str]]) -> None:
        rows = [r for r in rows if any(r)]
        if not rows:
            return
        width = max(map(len, rows))
        if width == 1 or len(rows) == 1:
            text = "\n\n".join(c.replace("\\|", "|") for r in rows for c in r if c)
        else:
            full = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            text = "\n".join([full[0], "|" + " --- |" * width, *full[1:]])
        if self.cell:
            self.cell[-1].append(text.replace("\n", " "))
        else:
            self.out.append(text)
            self.gaps.append("\n\n")
            self.items = False

    def write(self, roots: list[int]) -> str:
        tree = self.tree
        for root in roots:
            stack: list[int] = []
            i, end = root, tree.last[root]
            while i < end:
                while stack and i >= tree.last[stack[-1]]:
                    self.leave(stack.pop())
                if self.drop[i]:
                    i = tree.last[i]
                    continue
                if not tree.tag[i]:
                    self.line.append(tree.text[i])
                else:
                    self.enter(i)
                    stack.append(i)
                i += 1
            while stack:
                self.leave(stack.pop())
            self.flush()
        return "".join((gap if k else "") + block for k, (gap, block) in enumerate(zip(self.gaps, self.out, strict=True)))


def absolute(base: str, href: str) -> str:
    """A link's address on the web, or nothing."""
    if not href or href.startswith("#"):
        return ""
    try:
        target = urljoin(base, href)
    except ValueError:
        return ""
    return target if target.startswith(("http://", "https://")) else ""


def markdown(html: str | None, url: str | None = None) -> str:
    """Content of a page."""
    if not html:
        return ""
    tree = focused(html)
    roots, drop = ([0], [False] * len(tree.tag)) if tree else chosen(tree := Tree(html))
    return Writer(tree, drop, url or "").write(roots)


def extracted(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, url and content of every page (``key``, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [markdown(html, url) for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], [key, "url", "content"])

    rows = pages.select(key, "url", "html")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, url string, content string")
