"""Decontamination, archives, mixing, extraction, media: against brute force, SQL and round trips."""

import gzip
import hashlib
import html
import io
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, extract, mixing, tokens, warc, webp

# ---- words


def test_words():
    texts = ["Hello, world! hello", "", None, "Éa éA", "“a b”…c", "日本、語"]
    for _, w in tokens.pieces(pa.array(texts)):
        got = [[bytes(w.data[w.starts[k] : w.ends[k]]).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
        assert got == [["hello", "world", "hello"], [], [], ["éa", "éa"], ["a", "b", "c"], ["日本", "語"]]
        assert w.hashes[0] == w.hashes[2] != w.hashes[1]


def test_words_in_pieces(monkeypatch):
    rng = random.Random(0)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    whole = np.concatenate([w.hashes for _, w in tokens.pieces(pa.array(texts))])
    monkeypatch.setattr(tokens, "PIECE", 100)
    assert (np.concatenate([w.hashes for _, w in tokens.pieces(pa.array(texts))]) == whole).all()


# ---- decontamination


def contaminated(text, item):
    """By comparing the item with every place of the text."""
    a, b = (re.findall(r"\w+", x.lower()) for x in (text, item))
    best = 0
    for d in range(-len(b), len(a)):
        lo, hi = max(d, 0), min(d + len(b), len(a))
        if lo < hi:
            m, n = decontaminate.segment(np.array([a[k] == b[k - d] for k in range(lo, hi)]))
            if m >= decontaminate.IDENTITY * n:
                best = max(best, m)
    return len(b) > 0 and best >= (min(decontaminate.RUN, decontaminate.SHARE * len(b)) if len(b) >= decontaminate.LEAST else len(b))


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [" ".join(word() for _ in range(n)) for n in (5, 8, 12, 30, 50)] + ["too short"]
    docs = []
    for k in range(60):
        filler = [word() for _ in range(rng.randrange(0, 60))]
        passage = items[k % len(items)].split()
        if k % 3 == 1 and len(passage) > 6:
            passage[rng.randrange(len(passage))] = "changed"
        if k % 3 == 2:
            passage = passage[: len(passage) // 4]
        at = rng.randrange(len(filler) + 1)
        docs.append(" ".join(filler[:at] + [p.title() + "," for p in passage] + filler[at:]))
    docs += ["", None, "it was too short.", "too  long, short", "Single!", " ".join([word() for _ in range(30_000)] + items[3].split())]
    items += ["single", "a b c d", "?"]
    docs += ["x a b c d y", "x a b c z d"]
    rows = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(rows, bench).collect()}
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if contaminated(d or "", t)}
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontaminate.clean(rows, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}
    assert decontaminate.overlaps(rows, bench.limit(0)).count() == 0 and decontaminate.clean(rows.limit(0), bench).count() == 0


def test_seeds_that_many_items_share(monkeypatch):
    monkeypatch.setattr(decontaminate, "COMPARED", 50)
    texts = pa.array([f"all items begin with these same words and then {k} {k + 1} {k + 2} {k + 3}" for k in range(0, 400, 4)])
    index = decontaminate.Index(list(range(100)), texts)
    for _, w in tokens.pieces(pa.array(["all items begin with these same words and then 8 9 10 11", "all items begin"])):
        found = index.verified(w)
    assert found[0, 2] == (13, 13) and {i for i, _ in found} == {0}
    want = {j for j, t in enumerate(texts.to_pylist()) if contaminated("all items begin with these same words and then 8 9 10 11", t)}
    assert {j for _, j in found} == want


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2)
    docs = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "h i j k l m")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m"), (3, "n o p q r s")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == {(1, 1), (2, 2)}


def test_no_accepted_segment_is_without_a_seed():
    """All segments of up to 18 words (bits are matching words), and the most matches a longer one has without a seed."""
    bits = np.arange(1 << 18)
    ones, length = (np.array([f(x) for x in bits.tolist()]) for f in (int.bit_count, int.bit_length))
    for n in range(decontaminate.LEAST, 40):
        index = decontaminate.Index([0], pa.array([" ".join(f"w{i}" for i in range(n))]))
        used = [int(m[::-1], 2) for m in decontaminate.MASKS if decontaminate.MASKS.index(m) in index.masks and len(m) <= n]
        hit = np.logical_or.reduce([(bits >> k) & m == m for m in used for k in range(18)])
        accepted = (length <= n) & (ones >= min(decontaminate.RUN, decontaminate.SHARE * n)) & (ones >= decontaminate.IDENTITY * length)
        assert accepted.any() and hit[accepted].all()
        assert len(index.seeds) == sum(n - len(m) + 1 for m in decontaminate.MASKS if decontaminate.MASKS.index(m) in index.masks and len(m) <= n)
    most = {0: 0}  # of each last four bits
    for size in range(1, 200):
        step = {}
        for last, k in most.items():
            for bit in (0, 1):
                now = last << 1 | bit
                if not any(now & int(m, 2) == int(m, 2) for m in decontaminate.MASKS if m.count("1") == 4):
                    step[now & 15] = max(step.get(now & 15, 0), k + bit)
        most = step
        assert size <= 18 or max(most.values()) < decontaminate.IDENTITY * size


@pytest.mark.parametrize("n", [5, 7, 10, 12, 15, 20, 30])
def test_recall_of_substituted_items(n):
    """Three words of ten are substituted: what the rule accepts is found."""
    rng = random.Random(n)
    item = [f"w{i}" for i in range(n)]
    index = decontaminate.Index([0], pa.array([" ".join(item)]))
    texts = [" ".join(["x"] * 3 + ["y" if rng.random() < 0.3 else v for v in item] + ["x"] * 3) for _ in range(400)]
    got = {at + text for at, w in tokens.pieces(pa.array(texts)) for text, _ in index.verified(w)}
    want = {i for i, t in enumerate(texts) if contaminated(t, " ".join(item))}
    assert got == want and want


# ---- archives


def test_archives(spark, tmp_path):
    long = "<p>é" * 40_000
    rows = [(1, "http://a\r\nb", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 2000), (None, "u", "x" * 2000), (7, "u", "x" * 2000)]
    rows += [(None, "u", "y" * 1500), (None, None, "y" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    manifest = warc.write_archives(warc.decide(df), f"file://{tmp_path}/w")
    chunks = warc.read_chunks(manifest).collect()
    last = [c for c in chunks if c.last]
    assert len(last) == len(rows)
    for c in last:
        html = next(h or "" for i, _, h in rows if i == c.page_id and (i is not None or len(h) == c.payload_bytes))
        assert (c.payload_bytes, c.digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        if c.record_type == "response":
            parts = sorted((x for x in chunks if x.record_id == c.record_id), key=lambda x: x.chunk_no)
            if c.page_id not in (7, None):
                assert b"".join(bytes(x.chunk) for x in parts).decode() == html
            assert all(x.chunk_bytes <= warc.CHUNK_BYTES for x in parts)
    kinds = sorted(((c.page_id or 0), c.record_type, c.refers_to) for c in last)
    assert (1, "revisit", 2) in kinds and (2, "response", None) in kinds and kinds.count((7, "response", None)) == 2
    assert (0, "revisit", 7) in kinds and kinds.count((0, "response", None)) == 2  # a null id is never the largest
    assert [c.chunk_no for c in chunks if c.page_id == 2] == [0, 1, 2, 3]
    assert sum(r.records for r in manifest.collect()) == len(rows)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = con.sql(warc.OP2_SQL).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(((c.page_id, c.payload_bytes, c.digest, c.record_type, c.refers_to, c.chunk_no + 1) for c in last), key=key) == sorted((tuple(None if x != x else x for x in r) for r in want), key=key)
    assert warc.read_chunks(warc.write_archives(warc.decide(df.limit(0)), f"file://{tmp_path}/e")).count() == 0


def test_archives_are_rolled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(6)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.decide(df), f"file://{tmp_path}/w")
    assert manifest.count() == 6 and {r.records for r in manifest.collect()} == {1}
    assert sorted(bytes(r.chunk) for r in warc.read_chunks(manifest).collect()) == [b"page %d" % i for i in range(6)]


def test_damaged_archives_are_noticed():
    whole = warc.headers(1, "u", hashlib.sha1(b"body").hexdigest(), 4, None) + b"body\r\n\r\n"
    assert [r[-1] for r in warc.records_of(io.BytesIO(whole * 2))] == [True, True]
    for bad in (whole[:-7], whole.replace(b"body", b"bode"), b"junk" + whole, whole[:40]):
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(bad)))
    assert gzip.decompress(gzip.compress(whole)) == whole


# ---- mixing


def test_mixing_rules(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "ß", None, "Z", "tiny"] if i > 3 else ["tiny"])) for i in range(400)]
    rows = [(i, t, "tiny" if i < 3 else s if s != "tiny" else "a") for i, t, s in rows] + [(None, None, "a"), (7, "w w", "a"), (7, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df, ["source"]).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    sizes, targets, taken = {}, {}, {}
    for r in got:
        sizes[r.source], targets[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(targets.values()) - total) < 1e-6 and sum(sizes.values()) == total
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = {s: 0.0 for s in order}  # share and share again what goes over a limit
    for _ in range(50):
        free = [s for s in order if want[s] < 3 * sizes[s] - 1e-9]
        left = total - sum(want.values())
        for s in free:
            want[s] = min(3 * sizes[s], want[s] + left * weight[s] / sum(weight[f] for f in free))
    for s in order:
        assert abs(targets[s] - want[s]) < 1e-6
        assert abs(taken[s] - targets[s]) <= 0.05 * targets[s] + 5
    again = sorted(((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(df).collect()))
    assert again == sorted(((r.doc_id or -1, r.size, r.taken) for r in got))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_sql_has_the_blocks_of_small_sources(spark):
    rng = random.Random(8)
    names = ["a"] * 1500 + ["b"] * 300 + ["c"] * 20 + ["d"] * 3 + [None] * 40
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), s) for i, s in enumerate(names)] + [(5000, None, "a"), (5001, "w " * 3000, "b"), (5002, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "SLOTS", 500)
        assert mixing.plan(docs)[2] > 64  # far more than a block of c, d or null
        got = sorted(tuple(r) for r in mixing.mix(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql(mixing.OP5_SQL.replace("// 65536)", "// 500)")).fetchall())
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(got, want, strict=True))


def test_sampled_rows_follow_the_mixture(spark):
    df = spark.createDataFrame([(i, "w " * 10, "big" if i < 900 else "a") for i in range(1000)], "doc_id long, text string, source string")
    got = {r.source: r.n for r in mixing.sampled(df).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r.source: r.target / 10 for r in mixing.mix(df, ["source"]).select("source", "target").distinct().collect()}
    assert all(abs(got[s] - want[s]) < 0.05 * want[s] + 3 for s in want)


def test_small_sources_reach_their_targets(spark, monkeypatch):
    """Sources far below a block of the large ones: 0.01 to 3 blocks of 1000 tokens."""
    monkeypatch.setattr(mixing, "SLOTS", 500)
    sizes = {"a": 10, "b": 61, "c": 250_000, "d": 610, "e": 3276, "f": 250_000}
    rows = [(f"{s}{i}", "w " * min(n - i, 9), s) for s, n in sizes.items() for i in range(0, n, 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    assert mixing.plan(df)[2] == 1007
    got = {r.source: r for r in mixing.mix(df, ["source"]).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()}
    assert {s for s in sizes if got[s].target == 3 * sizes[s]} == {"a", "b", "d", "e"}
    for s in sizes:
        assert abs(got[s].taken - got[s].target) <= 0.02 * got[s].target + 2 and got[s].most <= 3


def test_whole_documents_keep_columns_of_any_name(spark):
    given = [(i, "word " * (1 + i % 7), f"s{i % 3}", "a", "b", 1.5) for i in range(60)] + [(None, None, None, "a", "b", None)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, __size string, __id string, `of.times` double")
    got = mixing.sampled(docs)
    assert got.columns == docs.columns and {r["__size"] for r in got.collect()} == {"a"}
    assert {tuple(r) for r in got.collect()} <= set(given)


# ---- extraction

ARTICLE = "<article><h1>Title</h1><p>First &amp; <b>bold</b>\n text</p><p>Second<br>line</p><ul><li>one<li>two</ul></article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>menu</nav><header>top</header>{ARTICLE}<aside>side</aside><footer>foot</footer></body></html>", "Title First & bold text Second line one two"),
        (f"<body>{ARTICLE[:-10]}<div class='comments'><article><p>nice post</p></article></div><script>var x='<p>no</p>'</script><form>name</form></article>", "Title First & bold text Second line one two"),
        ("<article><p>a<div class='ad'>buy</div><p class='cookie-notice'>cookies</p><p>b</article>", "a b"),
        ("<article><p>open <b>never closed", "open never closed"),
        ("<nav>only</nav>", ""),
        ("<article>x &#233; &nbsp; y</article>", "x é y"),
    ],
)
def test_main_text(html, text):
    assert extract.main_text(html) == text


def test_ratio_selects_unmarked_content():
    link = "<li><a href='/x'>link</a></li>"
    para = "<p>" + "many words without any markup between them " * 6 + "</p>"
    html = f"<body><ul>{link * 12}</ul>{para * 4}<ul>{link * 12}</ul></body>"
    got = extract.main_text(html)
    assert got.count("many words") == 24 and "link" not in got


def test_teasers_are_no_article():
    para = "<div>" + "many words without any markup between them " * 6 + "</div>"
    cards = "<article><h3><a href='/x'>teaser</a></h3><p>short words</p></article>" * 4
    for html in (f"<body>{para * 5}<div>{cards}</div></body>", f"<body><div>{cards}</div>{para * 5}</body>"):
        got = extract.main_text(html)
        assert got.count("many words") == 30 and got.count("teaser") + got.count("short words") <= 2


def test_unnamed_links_in_an_article_are_judged():
    link = "<li><a href='/x'>link</a></li>"
    para = "<p>" + "many words without any markup between them " * 6 + "</p>"
    got = extract.main_text(f"<body><article><ul>{link * 9}</ul><h1>Heading</h1>{para * 4}<p>End.</p><ul>{link * 9}</ul></article><div>other {para}</div></body>")
    assert got.startswith("Heading many") and got.endswith("End.") and got.count("many words") == 24


def test_containers_and_runs():
    para = "<p>" + "many words without any markup between them " * 6 + "</p>"
    note = "<p>short note</p>"
    link = "<p><a href='/x'>some link text</a></p>"
    # A container without any mark holds the content: its short lines belong to it, those around it do not.
    got = extract.main_text(f"<body><div>{note * 3}{link}</div><div><h1>Heading</h1>{para * 4}{link}<p>End.</p></div><div>{link}{note * 3}</div></body>")
    assert got.startswith("Heading many") and got.endswith("End.") and "note" not in got and "link" not in got
    # No container: runs of prose around content lines.
    got = extract.main_text(f"<body>{note}{link}<h1>Heading</h1>{para * 4}<p>End.</p>{link}{note}</body>")
    assert got.startswith("Heading many") and got.endswith("End.") and "note" not in got
    assert extract.main_text("<p>a</p><p>b</p>") == "a b"
    long = "word " * 400_000
    assert extract.main_text(f"<article><p>{long}</p></article>") == long.strip()


SF = "/root/testdata/sf0.01/pages.parquet"


def article_of(page):
    """The text between the marks of an article, by patterns only."""
    body = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*)</article>", page, re.S)[1], flags=re.S)
    body = re.sub(r"</?(p|h[1-6]|br|div|li|ul|ol)\b[^>]*>", " ", body)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", body))).strip()


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_pages_against_patterns(monkeypatch):
    pages = pq.read_table(SF)["html"].to_pylist()
    assert [extract.main_text(p) for p in pages] == [article_of(p) for p in pages]
    # Without marks and names the clusters find the article, but for neighbours that no tag tells from it.
    plain = [re.sub(r"(</?)(?:article|nav|footer)>", r"\1div>", p).replace(' class="ad"', "") for p in pages]
    found = [extract.main_text(p) for p in plain]
    assert sum(article_of(p) in x and len(x) < 1.2 * len(article_of(p)) + 100 for x, p in zip(found, pages, strict=True)) >= 0.9 * len(pages)
    # What the clusters say decides: with other lines as content other text comes back.
    monkeypatch.setattr(extract, "content", lambda ratio: ratio <= ratio.min())
    assert sum(extract.main_text(p) != x for p, x in zip(plain, found, strict=True)) >= 0.9 * len(pages)


WRAPPERS = [
    ('<div class="layout with-sidebar">', "</div>"),
    ('<div class="no-sidebar">', "</div>"),
    ('<div id="social-science">', "</div>"),
    ('<form id="aspnetForm">', "</form>"),
    ('<div class="sidebar right">', "</div>"),
    ('<div class="page social">', "</div>"),
]


def test_names_of_wrappers_lose_no_article():
    paras = "".join(f"<p>Paragraph {k} has a good many words and no markup at all in it.</p>" for k in range(12))
    want = re.sub(r"</?p>", " ", paras).replace("  ", " ").strip()
    for begin, end in [*WRAPPERS, ('<div class="page">', "</div>")]:
        assert extract.main_text(f"<body>{begin}<article>{paras}</article>{end}</body>") == want
        assert extract.main_text(f"<body>{begin}<nav>menu</nav><article>{paras}</article><footer>foot</footer>{end}</body>") == want
        assert extract.main_text(f"<body><nav>menu</nav>{begin}{paras}{end}<footer>foot</footer></body>") == want
    assert extract.main_text(f'<article><section class="legal-news">{paras}</section></article>') == want
    # Comments that are longer than the article stay out, beside a layout that is named like a sidebar, and in it.
    replies = '<section class="comments">' + "<div class='reply'><p>" + "I have read this and think quite otherwise. " * 30 + "</p></div>" * 3 + "</section>"
    for page in (f'<div class="sidebar-right"><article>{paras}</article></div>{replies}', f'<div class="sidebar-right"><article>{paras}</article>{replies}</div>'):
        assert extract.main_text(page) == want
    # A page of boilerplate only has no text.
    assert extract.main_text('<div class="cookie-notice"><p>We use cookies.</p></div><form>name<input></form><nav>menu</nav>') == ""
    # Composite names are names where their other words say nothing.
    for name in ("site-footer", "comments-area", "newsletter-signup", "related_posts", "ad1"):
        assert extract.main_text(f'<div>{paras}<div class="{name}">Some line of text.</div></div>') == want


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize(("begin", "end"), WRAPPERS)
def test_wrapped_pages_give_the_same_text(begin, end):
    for page in pq.read_table(SF)["html"].to_pylist():
        wrapped = re.sub(r"</body>", end + "</body>", re.sub(r"(<body[^>]*>)", rf"\1{begin}", page))
        assert wrapped != page and extract.main_text(wrapped) == extract.main_text(page)


def test_extract_rows(spark):
    rows = spark.createDataFrame([(1, "u", ARTICLE, 1), (None, None, None, 2), (1, "u", ARTICLE, 3)], "page_id long, url string, html string, text int")
    got = extract.extract(rows).collect()
    assert sorted(r.n_chars for r in got) == [0, 43, 43] and all(len(r.text) == r.n_chars for r in got)
    assert extract.extract(rows.limit(0)).count() == 0


# ---- media


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)])
@pytest.mark.parametrize("cache", [0, 1, 6, 11])
def test_lossless(transforms, cache):
    rng = np.random.default_rng(len(transforms) + cache)
    for colours in (2, 4, 16, 200):
        palette = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
        pixels = palette[np.repeat(rng.integers(0, colours, (9, 7)), 2, 1)]
        for references in (False, True):
            assert (webp.decode(webp.encode(pixels, transforms, cache, references)) == pixels).all()


class Reader:
    """An independent decoder, bit by bit, of files with any features but groups of codes and the predictors that no stored image has."""

    def __init__(self, data):
        size = int.from_bytes(data[16:20], "little")
        assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and len(data) == 20 + size + size % 2 == int.from_bytes(data[4:8], "little") + 8
        self.bits, self.seen = "".join(f"{x:08b}"[::-1] for x in data[20 : 20 + size]), set()
        self.at = 0

    def n(self, k):
        self.at += k
        return int(self.bits[self.at - k : self.at][::-1] or "0", 2)

    def code(self, size):
        if self.n(1):
            two, wide = self.n(1), self.n(1)
            return dict(zip(("0", "1") if two else ("",), sorted([self.n(8 if wide else 1), *([self.n(8)] if two else [])]), strict=True))
        first = [0] * 19
        for i in range(4 + self.n(4)):
            first[[17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15][i]] = self.n(3)
        inner, lengths, last = self.words(first), [], 8
        left = self.n(2 + 2 * self.n(3)) + 2 if self.n(1) else size
        while len(lengths) < size and left:
            left -= 1
            s = self.symbol(inner)
            if s < 16:
                lengths.append(s)
                last = s or last
            else:
                lengths += [last] * (3 + self.n(2)) if s == 16 else [0] * (3 + self.n(3)) if s == 17 else [0] * (11 + self.n(7))
        return self.words(lengths)

    def words(self, lengths):
        out, word = {}, ""
        for k, s in sorted((k, s) for s, k in enumerate(lengths) if k):
            word = word and f"{int(word, 2) + 1:0{len(word)}b}"
            word = word.ljust(k, "0")
            out[word] = s
        return out if len(out) > 1 else {"": s for s in out.values()}

    def symbol(self, code):
        word = ""
        while word not in code:
            word += self.bits[self.at]
            self.at += 1
        return code[word]

    def number(self, s):
        k = (s - 2) >> 1
        return s + 1 if s < 4 else ((2 + s % 2) << k) + self.n(k) + 1

    def image(self, w, h, top):
        k = self.n(4) if self.n(1) else 0
        assert not (top and self.n(1))
        codes = [self.code(x) for x in (280 + (1 << k if k else 0), 256, 256, 256, 40)]
        self.seen |= {"prefix codes"} if any(len(c) > 2 for c in codes) and top else set()
        out, cache = [], {}
        while len(out) < w * h:
            s, before = self.symbol(codes[0]), len(out)
            if s < 256:
                r, b, a = (self.symbol(c) for c in codes[1:4])
                out.append((a, r, s, b))
            elif s < 280:
                self.seen.add("back-references")
                size, far = self.number(s - 256), self.number(self.symbol(codes[4]))
                far = far - 120 if far > 120 else {1: w, 2: 1}[far]
                for _ in range(size):
                    out.append(out[-far])
            else:
                self.seen.add("colour cache")
                out.append(cache.get(s - 280, (0, 0, 0, 0)))
            for a, r, g, b in out[before:] if k else ():
                cache[((a << 24 | r << 16 | g << 8 | b) * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - k)] = (a, r, g, b)
        assert len(out) == w * h
        return out

    def pixels(self):
        assert self.n(8) == 0x2F
        w, h, _, version = self.n(14) + 1, self.n(14) + 1, self.n(1), self.n(3)
        undo, packed = [], w
        while self.n(1):
            kind = self.n(2)
            self.seen.add(("predictor", "cross-colour", "subtract green", "palette")[kind])
            if kind < 2:
                k = self.n(3) + 2
                undo.append((kind, k, packed, self.image(-(-packed >> k) if packed % (1 << k) == 0 else (packed >> k) + 1, (h + (1 << k) - 1) >> k, False)))
            elif kind == 2:
                undo.append((kind, 0, 0, None))
            else:
                colours = self.image(self.n(8) + 1, 1, False)
                for i in range(1, len(colours)):
                    colours[i] = tuple((x + y) % 256 for x, y in zip(colours[i - 1], colours[i], strict=True))
                per = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2 if len(colours) <= 16 else 1
                undo.append((kind, per, packed, colours))
                packed = -(-packed // per)
        out = self.image(packed, h, True)
        signed = lambda v: v - 256 if v > 127 else v
        for kind, k, w0, image in reversed(undo):
            if kind == 2:
                out = [(a, (r + g) % 256, g, (b + g) % 256) for a, r, g, b in out]
            elif kind == 3:
                size = 8 // k
                out = [image[out[y * -(-w0 // k) + x // k][2] >> (x % k * size) & ((1 << size) - 1)] for y in range(h) for x in range(w0)]
            elif kind == 1:
                done = []
                for i, (a, r, g, b) in enumerate(out):
                    _, rb, gb, gr = image[((i // w0) >> k) * ((w0 + (1 << k) - 1) >> k) + ((i % w0) >> k)]
                    red = (r + (signed(gr) * signed(g) >> 5)) % 256
                    done.append((a, red, g, (b + (signed(gb) * signed(g) >> 5) + (signed(rb) * signed(red) >> 5)) % 256))
                out = done
            else:
                done = []
                for i, v in enumerate(out):
                    y, x = divmod(i, w0)
                    mode = image[(y >> k) * ((w0 + (1 << k) - 1) >> k) + (x >> k)][2]
                    left, above, corner, right = (done[i - d] if i >= d else None for d in (1, w0, w0 + 1, w0 - 1))
                    mean = lambda p, q: tuple((m + n) // 2 for m, n in zip(p, q, strict=True))
                    if not i:
                        p = (255, 0, 0, 0)
                    elif not y or not x:
                        p = left if not y else above
                    else:
                        p = {1: left, 2: above, 3: right, 4: corner}.get(mode) or (mean(corner, above) if mode == 8 else mean(above, right))
                    done.append(tuple((m + n) % 256 for m, n in zip(p, v, strict=True)))
                out = done
        return np.array(out, np.uint8).reshape(h, w, 4)[:, :, [1, 2, 3, 0]]


def grey_images():
    rng = np.random.default_rng(2)
    text = lambda n, words: np.frombuffer((" ".join(rng.choice(words, n)) + " " * 64).encode(), np.uint8)
    words = ["the", "colour", "of", "a", "pixel", "is", "two", "Zwölf", "9,5", "(x)"] + ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(60)]
    raw = [np.zeros(64, np.uint8), np.full(128, 7, np.uint8), text(500, words), text(3000, words), text(400, ["Der"]), rng.integers(0, 256, 64 * 90, dtype=np.uint8), rng.integers(0, 3, 640, dtype=np.uint8), np.arange(64 * 256, dtype=np.uint32).astype(np.uint8)]
    return [x[: len(x) // 64 * 64].reshape(-1, 64) for x in raw]


@pytest.mark.parametrize("kind", webp.KINDS)
def test_grey_images_against_an_independent_decoder(monkeypatch, kind):
    images, seen = grey_images(), set()
    files = webp.write_grey(images, kind)
    assert [webp.write_grey([x], kind)[0] for x in images] == files  # company changes nothing
    for x, f in zip(images, files, strict=True):
        reader = Reader(f)
        assert (reader.pixels()[:, :, 0] == x).all()
        seen |= reader.seen
        got = webp.decode(f)
        assert (got == np.concatenate([np.repeat(x[:, :, None], 3, 2), np.full((*x.shape, 1), 255, np.uint8)], 2)).all()
    want = {webp.PALETTED: {"palette", "subtract green"}, webp.CACHED: {"colour cache"}, webp.CROSSED: {"cross-colour"}, webp.PREDICTED: {"predictor", "subtract green"}}
    assert seen == want[kind] | {"prefix codes", "back-references"}
    if kind != webp.PREDICTED:
        assert len(files[4]) < 0.2 * images[4].size and len(files[3]) < 0.65 * images[3].size
    read = webp.read_symbols  # the other way of reading gives the same
    monkeypatch.setattr(webp, "read_symbols", lambda *a: None)
    for x, f in zip(images[:3] + images[4:], files[:3] + files[4:], strict=True):
        assert (webp.decode(f)[:, :, 1] == x).all()
    monkeypatch.setattr(webp, "read_symbols", read)
    for bad in (files[3][:-40], b"RIFX" + files[3][4:], files[3][:20] + b"\0" + files[3][21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_code_lengths_are_complete():
    rng = np.random.default_rng(7)
    counts = (rng.pareto(0.5, (300, 280)) * (rng.random((300, 280)) < rng.random((300, 1)))).astype(np.int64).clip(0, 10**6)
    lengths = webp.code_lengths(counts)
    for c, x in zip(counts, lengths, strict=True):
        if (c > 0).sum() > 1:
            assert ((x > 0) == (c > 0)).all() and x.max() <= 15 and (1 << (15 - x[x > 0])).sum() == 1 << 15
            p = c[c > 0] / c.sum()
            assert (p * x[c > 0]).sum() < -(p * np.log2(p)).sum() + 1
        else:
            assert not x.any()


def test_the_query_meets_every_feature(monkeypatch):
    calls, texts = set(), ["", "some words of a text, some words of a text " * 30, "yes no yes no " * 20] + [f"text {k} with its own words {k * 7919} and more" * 3 for k in range(40)]
    for name in ("read_symbols", "undo_green", "undo_cross", "undo_palette", "undo_prediction"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: calls.add(n) or f(*a))
    payloads = [t.encode() + b"\0" * (-len(t.encode()) % 64 or (64 if not t else 0)) for t in texts]
    for p, m in zip(payloads, webp.store(payloads), strict=True):
        assert b"".join(x.tobytes() for x in webp.samples(m)) == p
    assert len(calls) == 5


def test_media_rows(spark, monkeypatch):
    monkeypatch.setattr(webp, "ROWS", 40)  # long texts take several images
    texts = ["", None, "é" * 3000, "a", "a", "x" * 64]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in webp.describe(webp.to_media(rows)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3].media_sha256 == got[4].media_sha256 and got[3].feature == got[4].feature and got[0].feature == got[1].feature
    assert webp.describe(webp.to_media(rows.limit(0))).count() == 0
