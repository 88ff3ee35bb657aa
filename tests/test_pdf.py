"""PDF filters against encoders of their own, and whole files packed by each of them."""

from __future__ import annotations

import base64
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.sources import filters, pdf

MOST = 1 << 22


def lzw_of(data: bytes, early: int = 1, full: int = 4093) -> bytes:
    """Bits as a string; the table is emptied when it has ``full`` entries."""
    bits, table, width, count = "", {}, 9, 0

    def put(code):
        nonlocal bits
        bits += format(code, f"0{width}b")

    def fresh():
        nonlocal table, width, count
        table, width, count = {bytes([b]): b for b in range(256)}, 9, 258

    fresh()
    put(256)
    held = b""
    for byte in data:
        longer = held + bytes([byte])
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer] = count
        count += 1
        width = max(width, (count + early - 1).bit_length())
        if count >= full:
            put(256)
            fresh()
        held = bytes([byte])
    if held:
        put(table[held])
        width = max(width, (count + early).bit_length())
    put(257)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def runs_of(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        n = 1
        while n < 128 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        if n > 1:
            out += bytes([257 - n]) + data[at : at + 1]
            at += n
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and data[end : end + 1] != data[end + 1 : end + 2]:
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return out + b"\x80"


def rows_of(data: bytes, columns: int, step: int, ways: list[int]) -> bytes:
    """PNG differences, a row in each way in turn, from the definitions of the five ways."""
    length, out = columns * step, b""
    above = bytes(length)
    for k, at in enumerate(range(0, len(data), length)):
        row, way = data[at : at + length], ways[k % len(ways)]
        out += bytes([way])
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            out += bytes([(x - (0, a, b, (a + b) // 2, paeth)[way]) % 256])
        above = row.ljust(length, b"\0")
    return out


some = st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"ab", b"aab", b"words ", b"\0\0\0"]), max_size=900).map(b"".join))


@settings(max_examples=60, deadline=None)
@given(some, st.sampled_from([0, 1]))
def test_lzw(data, early):
    assert filters.lzw(lzw_of(data, early), {"EarlyChange": early}, MOST) == data


@pytest.mark.parametrize("early", [0, 1])
def test_lzw_all_widths(early):
    data = b"".join(b"%d and %d; " % (k * 7919 % 10007, k) for k in range(6000))
    packed = lzw_of(data, early)
    assert filters.lzw(packed, {"EarlyChange": early}, MOST) == data
    assert filters.lzw(packed[:-40], {"EarlyChange": early}, MOST) == data[: len(filters.lzw(packed[:-40], {"EarlyChange": early}, MOST))]


@settings(max_examples=60, deadline=None)
@given(some)
def test_text_and_runs(data):
    assert filters.run_length(runs_of(data), {}, MOST) == data
    assert filters.ascii85(base64.a85encode(data, wrapcol=60) + b"~>", {}, MOST) == data
    assert filters.ascii_hex(data.hex(" ").encode() + b">rest", {}, MOST) == data


@settings(max_examples=60, deadline=None)
@given(some, st.integers(1, 40), st.sampled_from([1, 3, 4]), st.lists(st.integers(0, 4), min_size=1, max_size=6))
def test_rows(data, columns, step, ways):
    parameters = {"Predictor": 15, "Columns": columns, "Colors": step}
    assert filters.flate(zlib.compress(rows_of(data, columns, step, ways)), parameters, MOST) == data
    left = bytearray(data)
    for at in range(0, len(data), columns * step):
        for i in range(min(columns * step, len(data) - at) - 1, step - 1, -1):
            left[at + i] = (left[at + i] - left[at + i - step]) % 256
    assert filters.lzw(lzw_of(bytes(left)), parameters | {"Predictor": 2}, MOST) == data


@pytest.mark.parametrize(
    ("name", "packed", "parameters"),
    [
        ("LZW", lzw_of(b"x" * 5000), {}),
        ("Fl", zlib.compress(b"x" * 5000), {}),
        ("RL", runs_of(b"x" * 5000), {}),
        ("A85", b"z" * 1250, {}),
        ("AHx", b"00" * 5000, {}),
        ("LZW", b"\xff\xff\xff", {}),
        ("AHx", b"0g", {}),
        ("A85", b"\x7f", {}),
        ("Fl", zlib.compress(b"\x05abc"), {"Predictor": 12, "Columns": 3}),
        ("Fl", zlib.compress(b"abc"), {"Predictor": 2, "BitsPerComponent": 4}),
        ("Fl", zlib.compress(b"abc"), {"Predictor": 12, "Columns": -1}),
    ],
)
def test_refused(name, packed, parameters):
    with pytest.raises(ValueError):
        filters.FILTERS[name](packed, parameters, 4999)


def test_limit_itself_is_allowed():
    for name, packed in (("LZW", lzw_of(b"x" * 5000)), ("Fl", zlib.compress(b"x" * 5000)), ("RL", runs_of(b"x" * 5000))):
        assert filters.FILTERS[name](packed, {}, 5000) == b"x" * 5000


# ---- whole files


def file_of(content: bytes, head: bytes = b"", more: dict[int, bytes] | None = None, resources: bytes = b"") -> bytes:
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<<%s>>>>" % resources}
    objects[4] = b"<</Length %d %s>>\nstream\n%s\nendstream" % (len(content), head, content)
    return b"%PDF-1.6\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted((objects | (more or {})).items())) + b"trailer<</Root 1 0 R>>"


PAGE = b"BT /F 10 Tf 50 700 Td (%s) Tj 0 -12 Td (the end) Tj ET" % b" ".join(b"word%d" % k for k in range(900))
TEXT = " ".join(f"word{k}" for k in range(900)) + "\nthe end"


@pytest.mark.parametrize(
    ("content", "head"),
    [
        (PAGE, b""),
        (lzw_of(PAGE), b"/Filter/LZWDecode"),
        (lzw_of(PAGE, 0), b"/Filter/LZW/DecodeParms<</EarlyChange 0>>"),
        (base64.a85encode(zlib.compress(PAGE)) + b"~>", b"/Filter[/ASCII85Decode/FlateDecode]"),
        (runs_of(PAGE).hex().encode() + b">", b"/Filter[/AHx/RL]/DecodeParms[null null]"),
        (zlib.compress(rows_of(PAGE, 11, 1, [0, 1, 2, 3, 4])), b"/Filter/FlateDecode/DecodeParms<</Predictor 15/Columns 11>>"),
        (base64.a85encode(lzw_of(rows_of(PAGE, 5, 3, [4]))) + b"~>", b"/Filter[/A85/LZW]/DecodeParms[null<</Predictor 14/Columns 5/Colors 3>>]"),
    ],
)
def test_packed_pages(content, head):
    assert pdf.text_of(file_of(content, head)) == TEXT


def test_pictures_give_nothing():
    assert pdf.text_of(file_of(b"\xff\xd8(no)Tj", b"/Filter/DCTDecode")) is None
    assert pdf.text_of(file_of(b"BT (before) Tj ET BI /W 2 /H 2 ID (\xff( \n EI BT 0 -9 Td (after) Tj ET")) == "before\nafter"


def test_objects_in_packed_streams():
    body = b"<</Type/Catalog/Pages 2 0 R>> <</Type/Pages/Kids[3 0 R]>>"
    packed = lzw_of(rows_of(b"1 0 2 30 " + body, 8, 1, [2]))
    data = b"%%PDF-1.5\n3 0 obj<</Type/Page/Contents 4 0 R>>endobj 4 0 obj<</Length 17>>stream\nBT (packed) Tj ET\nendstream endobj 5 0 obj<</Type/ObjStm/N 2/First 9/Filter/LZWDecode/DecodeParms<</Predictor 12/Columns 8>>/Length %d>>\nstream\n%s\nendstream endobj" % (len(packed), packed)
    assert pdf.text_of(data) == "packed"


def test_objects_inside_a_stream_are_none():
    assert pdf.text_of(file_of(b"BT (4 0 obj << /Length 3 >> endobj 1 0 obj 7 endobj) Tj ET")) == "4 0 obj << /Length 3 >> endobj 1 0 obj 7 endobj"
    assert pdf.text_of(file_of(b"BT (later) Tj ET") + b"\n4 0 obj<</Length 18>>\nstream\nBT (changed) Tj ET\nendstream endobj") == "changed"


def test_objects_are_parsed_once(monkeypatch):
    places, parse = [], pdf.parse

    def counted(data, at=0):
        if data.startswith(b"%PDF"):
            places.append(at)
        return parse(data, at)

    monkeypatch.setattr(pdf, "parse", counted)
    assert pdf.text_of(file_of(runs_of(PAGE).hex().encode() + b">", b"/Filter[/AHx/RL]")) == TEXT
    assert len(places) == len(set(places)) == 4


@given(st.lists(st.sampled_from([b"obj", b"endobj", b"1", b"00", b"12345", b" ", b"\n", b"x", b"_"])).map(b"".join))
def test_heads_of_objects_are_those_read_forwards(data):
    assert pdf.heads(data) == [(int(m[1]), m.end()) for m in re.finditer(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b", data)]


@pytest.mark.parametrize(("shown", "text"), [(b"<4a 4\n b>", "JK"), (b"<4a4>", "J@"), (b"<4axx4b", "JK"), (b"<>", None)])
def test_strings_in_hexadecimal(shown, text):
    assert pdf.text_of(file_of(b"BT " + shown + (b" Tj ET" if b">" in shown else b"> Tj"))) == text

MAP = b"2 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 2 beginbfchar <41> <0061> <8041> <4e2d> endbfchar"


@pytest.mark.parametrize(
    ("font", "shown", "text"),
    [
        (b"/Subtype/Type1/Encoding<</Differences[1/fi/eacute 65/one/uni4E2D/T_h/nothing/quoteright.alt]>>", b"<0102414243444546>", "fié1中Th’F"),
        (b"/Subtype/TrueType/Encoding/MacRomanEncoding", b"<8e41>", "éA"),
        (b"/Subtype/TrueType/Encoding/WinAnsiEncoding", b"<e980>", "é€"),
        (b"/Subtype/Type0/Encoding/Identity-H", b"<00410042>", None),
        (b"/Subtype/Type0/Encoding/UniGB-UCS2-H", b"<4e2d0041>", "中A"),
        (b"/Subtype/Type0/Encoding/Identity-H/ToUnicode 9 0 R", b"<4180414199>", "a中a"),
    ],
)
def test_fonts(font, shown, text):
    more = {8: b"<</Type/Font%s>>" % font, 9: b"<</Filter/ASCIIHexDecode/Length %d>>stream\n%s\nendstream" % (2 * len(MAP), MAP.hex().encode())}
    assert pdf.text_of(file_of(b"BT /F 1 Tf %s Tj ET" % shown, more=more, resources=b"/Font<</F 8 0 R>>")) == text


def test_forms():
    form = lambda n, content, own=b"": b"<</Type/XObject/Subtype/Form/Length %d%s>>stream\n%s\nendstream" % (len(content), own, content)
    more = {5: form(5, b"BT (inside) Tj ET /B Do"), 6: form(6, b"BT (deeper) Tj ET /A Do")}
    names = b"/XObject<</A 5 0 R/B 6 0 R/C 7 0 R>>"
    assert pdf.text_of(file_of(b"BT (top) Tj ET /A Do /C Do BT (end) Tj ET", more=more, resources=names)) == "top\ninside\ndeeper\nend"
    towers = {5 + k: form(5 + k, b"/N Do /N Do", b"/Resources<</XObject<</N %d 0 R>>>>" % (6 + k)) for k in range(40)}
    towers[45] = form(45, b"BT (x) Tj ET")
    assert pdf.text_of(file_of(b"/A Do", more=towers, resources=b"/XObject<</A 5 0 R>>")) is None
