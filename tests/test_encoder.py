"""The encoder against single steps, weight files, PDF files, IPv6 literals."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import embed, encoder, urls
from millrace.sources import pdf

CONFIG = encoder.Config(12, 10, (encoder.SLIDING, encoder.FULL), 3, 1, 4, 4, 4, 50, projection_size=9)


@pytest.fixture
def made(tmp_path):
    parts = encoder.drawn(CONFIG, 3)
    for i, x in enumerate(parts):
        encoder.write_tensors(str(tmp_path / f"{i}"), x)
    return encoder.Encoder(CONFIG, *(encoder.Tensors([str(tmp_path / f"{i}")]) for i in range(3))), parts


def by_hand(ids, parts):
    """One text, one number after the other."""
    c, (w, first, second) = CONFIG, parts
    norm = lambda v, g: [x / math.sqrt(sum(y * y for y in v) / len(v) + c.rms_norm_eps) * (1 + k) for x, k in zip(v, g, strict=True)]
    times = lambda m, v: [sum(float(a) * b for a, b in zip(row, v, strict=True)) for row in m]

    def turned(v, pos, base):
        half, out = len(v) // 2, [0.0] * len(v)
        for i in range(half):
            t = pos / base ** (2 * i / len(v))
            out[i] = v[i] * math.cos(t) - v[i + half] * math.sin(t)
            out[i + half] = v[i + half] * math.cos(t) + v[i] * math.sin(t)
        return out

    states = [[float(x) * math.sqrt(c.hidden_size) for x in w["embed_tokens.weight"][i]] for i in ids]
    for k, kind in enumerate(c.layer_types):
        get = lambda n, k=k: w[f"layers.{k}.{n}.weight"]
        base = c.rope_theta if kind == encoder.FULL else c.rope_local_base_freq
        inputs = [norm(s, get("input_layernorm")) for s in states]
        heads = lambda n, v: [times(get(f"self_attn.{n}_proj"), v)[h * c.head_dim : (h + 1) * c.head_dim] for h in range(len(get(f"self_attn.{n}_proj")) // c.head_dim)]
        q = [[turned(norm(h, get("self_attn.q_norm")), p, base) for h in heads("q", v)] for p, v in enumerate(inputs)]
        key = [[turned(norm(h, get("self_attn.k_norm")), p, base) for h in heads("k", v)] for p, v in enumerate(inputs)]
        value = [heads("v", v) for v in inputs]
        after = []
        for p in range(len(ids)):
            joined = []
            for h in range(c.num_attention_heads):
                g = h * c.num_key_value_heads // c.num_attention_heads
                near = [j for j in range(len(ids)) if kind == encoder.FULL or abs(p - j) < c.sliding_window // 2 + 1]
                e = [math.exp(sum(a * b for a, b in zip(q[p][h], key[j][g], strict=True)) / math.sqrt(c.query_pre_attn_scalar)) for j in near]
                joined += [sum(x * value[j][g][d] for x, j in zip(e, near, strict=True)) / sum(e) for d in range(c.head_dim)]
            mid = [a + b for a, b in zip(states[p], norm(times(get("self_attn.o_proj"), joined), get("post_attention_layernorm")), strict=True)]
            y = norm(mid, get("pre_feedforward_layernorm"))
            gate = [0.5 * x * (1 + math.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3))) for x in times(get("mlp.gate_proj"), y)]
            inner = [a * b for a, b in zip(gate, times(get("mlp.up_proj"), y), strict=True)]
            after.append([a + b for a, b in zip(mid, norm(times(get("mlp.down_proj"), inner), get("post_feedforward_layernorm")), strict=True)])
        states = after
    states = [norm(s, w["norm.weight"]) for s in states]
    mean = [sum(col) / len(ids) for col in zip(*states, strict=True)]
    out = times(second["linear.weight"], times(first["linear.weight"], mean))
    return np.array(out)


def test_forward_against_single_numbers(made):
    model, parts = made
    batch = [[5, 7, 9], [1], [3, 3, 49, 0, 12, 6, 30]]
    got = model.vectors(batch)
    for ids, v in zip(batch, got, strict=True):
        want = by_hand(ids, parts)
        assert np.allclose(v, want / np.linalg.norm(want), atol=2e-4)
        assert np.allclose(model.vectors([ids])[0], v, atol=1e-5)  # padding changes nothing
    short = model.vectors(batch, 5)
    assert short.shape == (3, 5) and np.allclose(np.linalg.norm(short, axis=1), 1, atol=1e-5)
    for bad in ([], [[]], [[50]]):
        with pytest.raises(ValueError):
            model.vectors(bad)


def test_weight_files(tmp_path):
    path = str(tmp_path / "w")
    encoder.write_tensors(path, {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.zeros(0, np.float32)})
    t = encoder.Tensors([path])
    assert t.get("a", 2, 3).tolist() == [[0, 1, 2], [3, 4, 5]] and t.get("b", 0).size == 0
    for name, shape, error in (("a", (3, 2), ValueError), ("c", (1,), KeyError)):
        with pytest.raises(error):
            t.get(name, *shape)
    with pytest.raises(ValueError):
        encoder.Tensors([path, path])
    (tmp_path / "x").write_bytes(b"\xff" * 16)
    with pytest.raises(ValueError):
        encoder.Tensors([str(tmp_path / "x")])
    with pytest.raises(ValueError):
        encoder.Config(12, 10, ("other",), 3, 1, 4, 4, 4, 50)


def test_encoder_as_a_model(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None), (3, "some words"), (4, "others " * 700)], "id int, body string")
    got = {r.id: r.embedding for r in embed.embed(df, "id", "body", model=encoder.model(encoder.small), dims=16).collect()}
    assert got[1] == pytest.approx(got[3], abs=1e-5) and all(sum(x * x for x in v) == pytest.approx(1, abs=1e-4) for v in got.values())
    assert got[1] != pytest.approx(got[4], abs=1e-3)


# ---- PDF


def pdf_file(pages, compressed=False, cmap=None):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids, n = [], 5
    for content in pages:
        raw = zlib.compress(content) if compressed else content
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode " if compressed else b"", raw)
        kids.append(b"%d 0 R" % n)
        n += 2
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(pages))
    objects[3] = b"<< /Type /Font /Subtype /Type1 %s>>" % (b"/ToUnicode 4 0 R " if cmap else b"")
    if cmap:
        objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <00e9> <0002> <d835dd38> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange 1 beginbfrange <0020> <0021> [<0078> <0079>] endbfrange"


@pytest.mark.parametrize(
    ("data", "text"),
    [
        (None, None),
        (b"", None),
        (b"no such file", None),
        (b"%PDF-1.4 broken", None),
        (pdf_file([b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td (second\\040line) Tj ET"]), "Hello (world)\nsecond line"),
        (pdf_file([b"BT (one) Tj ET", b"BT [(t) 20 (wo) -300 (words)] TJ T* (next) ' ET"], compressed=True), "one\n\ntwo words\nnext"),
        (pdf_file([b"BT /F1 9 Tf <00010010001100120020002100020099> Tj ET"], cmap=CMAP), "éABCxy𝔸"),
        (pdf_file([b"BT 1 0 0 1 10 20 Tm (same) Tj 1 0 0 1 60 20 Tm (row) Tj 1 0 0 1 10 5 Tm (lower) Tj ET"]), "same row\nlower"),
        (pdf_file([b"BT (secret) Tj ET"]).replace(b"/Root", b"/Encrypt 9 0 R /Root"), None),
        (pdf_file([b"q 1 0 0 1 0 0 cm Q"]), None),
    ],
)
def test_pdf_text(data, text):
    assert pdf.text_of(data) == text


def test_pdf_objects_in_streams_and_rows(spark):
    packed = b"1 0 2 34 " + b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] >>"
    stream = zlib.compress(packed)
    data = b"%%PDF-1.5\n3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj << /Length 99 >> stream\nBT (packed) Tj ET\nendstream endobj 5 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj" % (len(stream), stream)
    assert pdf.text_of(data) == "packed"
    rows = spark.createDataFrame([("a", bytearray(data)), ("b", None), ("c", bytearray(data[:90]))], "url string, body binary")
    assert {r.url: r.content for r in pdf.extracted(rows).collect()} == {"a": "packed", "b": None, "c": None}


# ---- addresses


@pytest.mark.parametrize(
    ("url", "good"),
    [
        ("http://[2606:4700::1111]/x", True),
        ("https://[2606:4700:0:0:0:0:0:1]:8443/", True),
        ("http://[::1]/", False),
        ("http://[::]/", False),
        ("http://[::ffff:10.0.0.1]/", False),
        ("http://[::ffff:8.8.8.8]/", True),
        ("http://[::8.8.8.8]/", True),
        ("http://[fe80::1]/", False),
        ("http://[fec0::1]/", False),
        ("http://[FD00::1]/", False),
        ("http://[ff02::1]/", False),
        ("http://[64:ff9b:1::808:808]/", False),
        ("http://[64:ff9b::808:808]/", True),
        ("http://[2001:db8::1]/", False),
        ("http://[2001:2::1]/", False),
        ("http://[1:2:3]/", False),
        ("http://[1::2::3]/", False),
        ("http://[12345::]/", False),
        ("http://u@[2606:4700::1111]/", False),
    ],
)
def test_ipv6_literals(spark, url, good):
    assert spark.createDataFrame([(url,)], "u string").select(urls.is_fetchable(F.col("u"))).first()[0] is good
