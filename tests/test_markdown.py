"""Readable content: measures against a walk of every subtree, shapes of Markdown, forum pages, broken markup."""

import random

import pytest

from millrace.sources import markdown as m

PARA = "Words enough for a paragraph, with a comma, and then some more of them to be counted as prose."


def subtree(tree, i):
    return [k for k in range(len(tree.tag)) if k == i or i in m.ancestors(tree, k)]


def walked(tree, i):
    """Length, length in links, and points of a subtree, by going through all nodes."""
    size = linked = 0
    points = 0.0
    for k in subtree(tree, i):
        if not tree.tag[k]:
            n = len(m.SPACE.sub("", tree.text[k]))
            size += n
            linked += n * any(tree.tag[a] == "a" and (a == i or i in m.ancestors(tree, a)) for a in m.ancestors(tree, k))
        elif k != i and tree.tag[k] in m.SCORED:
            inner = [x for x in subtree(tree, k) if not tree.tag[x]]
            n = sum(len(m.SPACE.sub("", tree.text[x])) for x in inner)
            if n >= m.LEAST:
                flat = [x for x in inner if all(tree.tag[a] not in m.BLOCKS for a in m.ancestors(tree, x) if a > k)]
                worth = 1 + sum(len(m.COMMA.findall(tree.text[x])) for x in flat) + min(n / 100, 3)
                distance = list(m.ancestors(tree, k)).index(i)
                if distance < len(m.SHARES):
                    points += worth * m.SHARES[distance]
    return size, linked, points


def some_page(rng, depth=0):
    tag = rng.choice(["div", "p", "ul", "li", "table", "tr", "td", "section", "a", "b", "blockquote", "span", "pre", "h2"])
    inner = "".join(some_page(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else rng.choice([PARA, "x", "a, b", " ", ""]) for _ in range(rng.randrange(4)))
    end = f"</{tag}>" if rng.random() < 0.85 else rng.choice(["", "</div>", "</p></li>"])
    return f"<{tag} class='{rng.choice(['', 'ad', 'main', 'no-sidebar'])}'>{inner}{end}"


@pytest.mark.parametrize("seed", range(30))
def test_measures_are_those_of_a_walk(seed):
    rng = random.Random(seed)
    tree = m.Tree("".join(some_page(rng) for _ in range(3)))
    size, linked, points = m.measured(tree)
    for i in range(len(tree.tag)):
        if tree.tag[i]:
            want = walked(tree, i)
            assert (size[i], linked[i]) == want[:2] and points[i] == pytest.approx(want[2])
            assert subtree(tree, i) == list(range(i, tree.last[i]))  # a subtree is a run
    m.markdown("".join(some_page(rng) for _ in range(3)), "https://example.com/")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        (f"<h1>T</h1><p>{PARA}", f"# T\n\n{PARA}"),
        (f"<p>{PARA}<p>second <b>bold</b> and <i>soft</i><h2>H</h2>", f"{PARA}\n\nsecond **bold** and *soft*\n\n## H"),
        (f"<p>{PARA} <a href='/x?a=1'>here</a> <a href='javascript:0'>there</a></p>", f"{PARA} [here](https://example.com/x?a=1) there"),
        ("<ul><li>one<li>two<ol><li>a<li>b</ol><li>three</ul>", "- one\n- two\n  1. a\n  2. b\n- three"),
        (f"<p>{PARA}</p><table><tr><th>a<th>b<tr><td>1|2<td>x<br>y</table>", f"{PARA}\n\n| a | b |\n| --- | --- |\n| 1\\|2 | x y |"),
        (f"<p>{PARA}</p><pre><code>if x:\n    y  =  1\n</code></pre>", f"{PARA}\n\n```\nif x:\n    y  =  1\n```"),
        (f"<blockquote><p>{PARA}</p><p>more</p></blockquote>", f"> {PARA}\n\n> more"),
        (f"<p>{PARA}<br>next  <code>a  b</code>", f"{PARA}\nnext `a b`"),
        (f"<nav>menu</nav><div class='sidebar'>side</div><div><p>{PARA}</p></div><footer>foot</footer><script>var x = '<p>no</p>'</script>", PARA),
        (f"<div class='layout with-sidebar'><p>{PARA}</p></div>", PARA),
        (f"<form><p>{PARA}</p></form>", PARA),
        ("<p>caf&eacute; &lt;b&gt; &#233;</p>", "café <b> é"),
        ("<b>no <p>end", "no\n\nend"),
        ("</div></p>stray", "stray"),
    ],
)
def test_shapes(html, text):
    assert m.markdown(html, "https://example.com/a/b") == text


def test_content_by_points_and_links():
    link = "<li><a href='/x'>a link with quite some text in it, really</a></li>"
    page = f"<div><ul>{link * 30}</ul></div><div id='c'><h2>Head</h2><p>{PARA}</p><p>{PARA}</p><ul>{'<li>a point</li>' * 3}</ul></div><div><ul>{link * 20}</ul></div>"
    got = m.markdown(page, "https://example.com/")
    assert got.startswith("## Head") and got.count("comma") == 2 and got.endswith("- a point") and "link" not in got


def test_depth_and_size():
    deep = "<div>" * 20_000 + f"<p>{PARA}</p>"
    assert m.markdown(deep) == PARA
    long = f"<p>{PARA}</p>" * 3000
    assert m.markdown(f"<article>{long}</article>").count("comma") == 3000


FORUM = """<html><head><meta name="generator" content="Discourse 1"><script id="data-preloaded">{"cooked":"escaped copy"}</script></head><body>%s
<div id="topic-title"><h1>Async help</h1></div><div class="topic-body crawler-post"><div class="post"><p>The issue is that the future returns the unit type.</p><pre><code>async { op()? }</code></pre></div></div>
<div class="crawler-post"><div class="post"><p>Thanks.</p></div></div><div id="related-topics">Unrelated topic list</div>%s</body></html>"""


@pytest.mark.parametrize("around", [("", ""), ("<noscript>", "</noscript>")])
def test_forum_pages(around):
    got = m.markdown(FORUM % around, "https://forum.example/t/1")
    assert got == "# Async help\n\nThe issue is that the future returns the unit type.\n\n```\nasync { op()? }\n```\n\nThanks."


def test_pages_as_rows(spark):
    rows = spark.createDataFrame([("a", "https://example.com/", "<p>text <a href='b'>x</a>"), (None, None, None)], "page_id string, url string, html string")
    assert sorted(map(tuple, m.extracted(rows).collect()), key=repr) == [("a", "https://example.com/", "text [x](https://example.com/b)"), (None, None, "")]


def test_short_article_beside_a_long_footer():
    foot = "<footer>" + "All rights of the owners reserved. " * 9 + "</footer>"
    assert m.markdown(f"<article><h1>Title here</h1><p><b>Title here<br></article>{foot}") == "# Title here\n\n**Title here**"
    assert m.markdown(f"<article><p>Words of an article, of some length.</p></article>{foot}") == "Words of an article, of some length."
    assert "All rights" in m.markdown(f"<form>{foot}<article></article></form>")  # an empty article is none
