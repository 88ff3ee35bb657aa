"""The store: exact ids, chunks stored once, roots that notice damage, positions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import tokenstore

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", None, "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a  b<|endoftext|>日", "<|endoftext |>", "Hello world, it's  a\n\n test ''s !!  ??\n", "<|endoftext|> x", "日本語 text", "a\x1cb\x85c   d  e", "x²½ 12³ª", "“q”…—  ‘z’", "Ωmega", " leading", "Hello " * 4000, "Hello " * 4000, "é à ü " * 50]


@pytest.fixture(scope="module")
def want():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenstore.TOKENIZER))
    return [[*e.ids, tokenstore.END_ID] for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


def test_encoder(want):
    enc = tokenstore.load_encoder(tokenstore.TOKENIZER)
    for _ in range(2):  # learned, then remembered
        ids, bounds = enc.encode([t or "" for t in TEXTS])
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_special_tokens_as_the_library_has_them(want):
    assert [len(x) for t, x in zip(TEXTS, want, strict=True) if t == "hello <|endoftext|> world"] == [5]
    assert 50256 in want[TEXTS.index("<|endoftext|> x")] and 50256 not in want[TEXTS.index("<|endoftext |>")]


def thue_morse(n):
    """Two words of 2^n letters that polynomial hashes modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_encoder_on_texts_that_some_hashes_confuse():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenstore.TOKENIZER))
    texts = [*thue_morse(11), "x " + thue_morse(10)[1], *thue_morse(10)]
    ids, bounds = tokenstore.load_encoder(tokenstore.TOKENIZER).encode(texts)
    for x, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == [*t.encode(x, add_special_tokens=False).ids, tokenstore.END_ID]


@pytest.mark.parametrize("confused", [False, True])
def test_encoder_in_slices(monkeypatch, confused):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["new", "word", "é1", "(x)", "longer,", "7"], n)) for n in rng.integers(0, 60, 40)] + ["z" * 500 + " end"]
    monkeypatch.setattr(tokenstore, "PIECE", 70)
    if confused:  # all pieces of one length have one hash: bytes decide
        monkeypatch.setattr(tokenstore, "sums", lambda data, starts: np.arange(len(data) + 1, dtype=np.uint64))
    t = Tokenizer.from_file(public_tokenizers.path(tokenstore.TOKENIZER))
    enc = tokenstore.load_encoder(tokenstore.TOKENIZER)
    for _ in range(2):
        ids, bounds = enc.encode(texts)
        for x, a, b in zip(texts, bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == [*t.encode(x, add_special_tokens=False).ids, tokenstore.END_ID]


def test_cuts_are_local():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 60_000).astype(np.uint16)
    ends = tokenstore.cuts(tokenstore.marks_of(ids).tolist(), len(ids))
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= tokenstore.MOST and min(np.diff([0, *ends])[:-1]) >= tokenstore.LEAST
    moved = np.concatenate((rng.integers(0, 50_000, 500).astype(np.uint16), ids))
    again = {e - 500 for e in tokenstore.cuts(tokenstore.marks_of(moved).tolist(), len(moved))}
    assert len(again & set(ends)) > 0.9 * len(ends)


def test_merkle_roots():
    leaves = [bytes([i]) * 16 for i in range(5)]
    assert tokenstore.merkle(leaves) != tokenstore.merkle(leaves[::-1]) != tokenstore.merkle(leaves[:-1])
    assert tokenstore.merkle([]) == b"\0" * 16


def test_store(spark, tmp_path, want):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(None, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    recipes = tokenstore.write_store(df, f"file://{tmp_path}/s")
    got = {r.doc_id: r for r in tokenstore.read_store(recipes).collect()}
    at = got[None].n_tokens
    assert got[None].start == 0
    for i in reversed(range(len(TEXTS))):
        r, raw = got[100 - i], np.array(want[i], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[i]), zlib.crc32(raw))
        at += len(want[i])
    places = recipes.select(F.explode("chunks").alias("c")).select("c.digest", "c.path", "c.offset", "c.first").distinct()
    assert places.count() == places.select("digest").distinct().count()  # each chunk at one place
    starts = [r.start for r in spark.read.parquet(f"file://{tmp_path}/s/recipes").collect()]
    assert sorted(starts) == sorted(r.start for r in got.values())
    packs = list((tmp_path / "s" / "packs").glob("*.pack"))
    assert packs and not (tmp_path / "s" / "staging").exists()
    for p in packs:
        raw = bytearray(p.read_bytes())
        raw[12] ^= 0xFF
        p.write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        tokenstore.read_store(recipes).collect()


def test_empty_store(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenstore.read_store(tokenstore.write_store(df, f"file://{tmp_path}/e")).count() == 0
