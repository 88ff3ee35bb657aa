"""Text of PDF files: objects, packed streams, the page tree, and the text operators of page contents and of forms in them.

Codes of a font become characters by its ToUnicode map, else by its encoding and the glyph names that replace parts of it;
codes of composite fonts without a map are glyph numbers and give nothing.  Defined cases: encrypted or damaged files and
those with streams or texts of more than ``MOST_BYTES`` have no text at all (null, never a part of it); streams of pictures
and other unknown filters are empty.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from binascii import unhexlify
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.sources.filters import FILTERS

#: The head of an object read backwards: a search for its one fixed word does not stop at every digit of a stream.
OBJECT = re.compile(rb"jbo(?<!\wjbo)\s+\d{1,5}\s+(\d{1,10})(?!\d)")
TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|/[^\s()<>\[\]{}/%]*|[\[\]{}]|\(|<|[^\s()<>\[\]{}/%]+")
INTEGER, REAL, NUMERIC = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?\d*\.\d*"), b"+-.0123456789"
STREAM = re.compile(rb"\s*stream\r?\n")
#: The end of a picture's bytes inside page contents.
PICTURE_END = re.compile(rb"\sEI(?=\s|$)")
#: Bytes that a stream may unpack to and characters of a file's text; levels of trees.
MOST_BYTES, DEPTH = 64 << 20, 64

#: Names of glyphs that no rule of ``glyph`` makes.
GLYPHS = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
        "colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar "
        "braceright asciitilde quoteleft quoteright quotedblleft quotedblright endash emdash bullet ellipsis minus germandbls ae AE oe OE "
        "oslash Oslash dotlessi ff fi fl ffi ffl".split(),
        [*" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u2018\u2019\u201c\u201d\u2013\u2014\u2022\u2026\u2212\u00df\u00e6\u00c6\u0153\u0152\u00f8\u00d8\u0131", "ff", "fi", "fl", "ffi", "ffl"],
        strict=True,
    )
)
#: Accents that follow a letter in the name of a glyph, as combining characters.
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328"}
#: Encodings by name; others are read as the first.
ENCODINGS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
#: Keywords that are values.
KEYWORDS = {b"true": True, b"false": False, b"null": None}


def glyph(name: str) -> str:
    """Characters of a glyph's name; unknown names have none."""
    parts = name.split(".")[0].split("_")
    if len(parts) > 1:
        return "".join(glyph(x) for x in parts)
    name = parts[0]
    if len(name) == 1 or name in GLYPHS:
        return GLYPHS.get(name, name)
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        if m[1]:
            return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
        return chr(int(m[2], 16)) if int(m[2], 16) < 0x110000 else ""
    if name[1:] in ACCENTS:
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    try:
        return unicodedata.lookup(f"DIGIT {name.upper()}")
    except KeyError:
        return ""


class Name(str):
    """A name such as /Type."""


class Reference(int):
    """The number of another object."""


class Word(bytes):
    """An operator or keyword."""


def string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that begins before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C and at < len(data):
            c = data[at]
            at += 1
            if c in b"01234567":
                digits = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2])[0]
                out.append(int(digits, 8) & 255)
                at += len(digits) - 1
            elif c in b"\r\n":
                at += c == 13 and data[at : at + 1] == b"\n"
            else:
                out.append({0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}.get(c, c))
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def hexadecimal(digits: bytes) -> bytes:
    """A string in hexadecimal digits; other characters count for nothing, a missing last digit is 0."""
    try:
        return unhexlify(digits)
    except ValueError:
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
        return unhexlify(digits + b"0" * (len(digits) % 2))


def heads(data: bytes) -> list[tuple[int, int]]:
    """(number, where its head ends) of what looks like an object, in the order of the file."""
    return [(int(m[1][::-1]), len(data) - m.start()) for m in OBJECT.finditer(data[::-1])][::-1]


def parse(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(value, where it ends) of the values in a row; containers are lists and dicts, references resolve ``n g R``."""
    stack: list[list] = []
    kinds: list[bytes] = []

    def closed(items: list, kind: bytes):
        if kind == b"[":
            return items
        return {str(k): v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}

    while (m := TOKEN.search(data, at)) is not None:
        t, at = m[0], m.end()
        first = t[0]
        if first == 0x25:
            continue
        if t in (b"[", b"<<"):
            stack.append([])
            kinds.append(t)
            continue
        if t in (b"]", b">>"):
            if not stack:
                continue
            value = closed(stack.pop(), kinds.pop())
        elif t == b"(":
            value, at = string(data, at)
        elif t == b"<":
            end = data.find(b">", at)
            value, at = hexadecimal(data[at : end if end >= 0 else len(data)]), end + 1 if end >= 0 else len(data)
        elif first == 0x2F:
            value = Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]) if b"#" in t else t[1:]).decode("latin-1"))
        elif first in NUMERIC and INTEGER.fullmatch(t):
            value = int(t)
        elif first in NUMERIC and REAL.fullmatch(t) and t.strip(b"+-") != b".":
            value = float(t)
        elif t == b"R" and stack and len(stack[-1]) >= 2 and all(type(x) is int for x in stack[-1][-2:]):
            stack[-1].pop()
            value = Reference(stack[-1].pop())
        else:
            value = KEYWORDS[t] if t in KEYWORDS else Word(t)
            if value == b"ID" and not stack:
                end = PICTURE_END.search(data, at)
                at = end.end() if end else len(data)
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Document:
    def __init__(self, data: bytes):
        self.data = data
        if b"/Encrypt" in data:
            raise ValueError("the file is encrypted")
        self.values: dict[int, tuple[object, int]] = {}  # what was parsed, by its place
        found = heads(data)
        self.objects, kept, until = dict(found), {}, 0  # all of them, to look lengths up
        for number, at in found:
            if at >= until:  # what looks like an object inside a stream is none
                kept[number] = at
                until = self.read(at)[2]
        self.objects = kept
        self.packed: dict[int, object] = {}
        self.readers: dict[int, Callable[[bytes], str]] = {}
        self.forms: dict[int, str] = {}
        for number in list(self.objects):
            value, stream = self.load(number)
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream is not None:
                raw, first = self.unpacked(value, stream), self.get(value.get("First")) or 0
                numbers = [v for v, _ in parse(raw[:first])]
                for k, offset in zip(numbers[::2], numbers[1::2], strict=False):
                    self.packed.setdefault(k, next((v for v, _ in parse(raw, first + offset)), None))

    def load(self, number: int) -> tuple[object, bytes | None]:
        """(value, raw stream) of an object."""
        if number not in self.objects:
            return self.packed.get(number) if number in self.packed else None, None
        value, start, end = self.read(self.objects[number])
        return value, self.data[start:end] if start else None

    def read(self, at: int) -> tuple[object, int, int]:
        """(value, where its stream starts, where it ends) of the object at a place; without a stream both are 0."""
        if at not in self.values:
            self.values[at] = next(parse(self.data, at), (None, 0))
        value, at = self.values[at]
        if type(value) is int:  # an object that is a reference only
            return None, 0, 0
        m = STREAM.match(self.data, at) if isinstance(value, dict) else None
        if not m:
            return value, 0, 0
        size = value.get("Length")
        size = self.load(size)[0] if isinstance(size, Reference) else size
        if type(size) is not int or not re.match(rb"\s*endstream", self.data[m.end() + size : m.end() + size + 20]):
            end = self.data.find(b"endstream", m.end())
            size = (end if end >= 0 else len(self.data)) - m.end()
        return value, m.end(), m.end() + size

    def get(self, value: object):
        for _ in range(DEPTH):
            if not isinstance(value, Reference):
                return value
            value = self.load(value)[0]
        return None

    def unpacked(self, value: dict, raw: bytes) -> bytes:
        listed = lambda v: v if isinstance(v, list) else [v]
        filters = [self.get(f) for f in listed(self.get(value.get("Filter")) or [])]
        given = [self.get(p) for p in listed(self.get(value.get("DecodeParms")))] + [None] * len(filters)
        for f, p in zip(filters, given, strict=False):
            if f not in FILTERS:
                return b""
            raw = FILTERS[f](raw, {k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {}, MOST_BYTES)
        return raw

    def stream(self, value: object) -> bytes:
        if isinstance(value, Reference):
            head, raw = self.load(value)
            if isinstance(head, list):
                return self.stream(head)
            return self.unpacked(head, raw) if raw is not None else b""
        return b"\n".join(self.stream(v) for v in value) if isinstance(value, list) else b""

    def pages(self) -> Iterator[dict]:
        """Pages in the order of the page tree, with what they inherit."""
        every = [self.load(n)[0] for n in [*self.objects, *self.packed]]
        root = next((v for v in every if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        seen: set[int] = set()

        def walk(node: object, above: dict, depth: int) -> Iterator[dict]:
            if isinstance(node, Reference):
                if node in seen:
                    return
                seen.add(node)
            node = self.get(node)
            if not isinstance(node, dict) or depth > DEPTH:
                return
            node = ({"Resources": above["Resources"]} if "Resources" in above else {}) | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    yield from walk(kid, node, depth + 1)
            else:
                yield node

        if root:
            yield from walk(root.get("Pages"), {}, 0)
        else:
            yield from (v for v in every if isinstance(v, dict) and v.get("Type") == "Page")

    def reader(self, font: object) -> Callable[[bytes], str]:
        """From codes of a font to characters."""
        key = int(font) if isinstance(font, Reference) else None
        if key is None or key not in self.readers:
            made = self.new_reader(self.get(font))
            if key is None:
                return made
            self.readers[key] = made
        return self.readers[key]

    def new_reader(self, font: object) -> Callable[[bytes], str]:
        font = font if isinstance(font, dict) else {}
        if "ToUnicode" in font:
            sizes, table = self.map_of(font)

            def mapped(raw: bytes) -> str:
                out, at = [], 0
                while at < len(raw):
                    n = next((n for n in sizes if raw[at : at + n] in table), sizes[0])
                    out.append(table.get(raw[at : at + n], ""))
                    at += n
                return "".join(out)

            return mapped
        encoding = self.get(font.get("Encoding"))
        if self.get(font.get("Subtype")) == "Type0":
            wide = isinstance(encoding, Name) and ("UCS2" in encoding or "UTF16" in encoding)
            return lambda raw: raw.decode("utf-16-be", "replace") if wide else ""
        details = encoding if isinstance(encoding, dict) else {}
        base = self.get(details.get("BaseEncoding")) if details else encoding
        characters = [bytes([b]).decode(ENCODINGS.get(base, "cp1252"), "replace") for b in range(256)]
        code = 0
        for x in self.get(details.get("Differences")) or []:
            if isinstance(x, Name):
                if code < 256:
                    characters[code] = glyph(x)
                code += 1
            elif type(x) is int and x >= 0:
                code = x
        return lambda raw: "".join(characters[b] for b in raw)

    def map_of(self, font: dict) -> tuple[list[int], dict[bytes, str]]:
        """(bytes that a code may have, code -> characters) of a font's ToUnicode map."""
        raw, out, sizes = self.stream(font["ToUnicode"]), {}, set()
        items = [v for v, _ in parse(raw)]
        text = lambda b: b.decode("utf-16-be", "replace")
        at = 0
        while at < len(items):
            kind = items[at]
            at += 1
            if kind not in (b"beginbfchar", b"beginbfrange", b"begincodespacerange"):
                continue
            while at + 1 < len(items) and isinstance(items[at], bytes) and not isinstance(items[at], Word):
                low, high = items[at], items[at + 1]
                at += 2
                sizes.add(max(len(low), 1))
                if kind == b"beginbfchar":
                    out[low] = text(high)
                elif kind == b"beginbfrange" and at < len(items):
                    to = items[at]
                    at += 1
                    a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    for k in range(min(b - a + 1, 1 << 16)):
                        code = (a + k).to_bytes(len(low), "big")
                        if isinstance(to, list):
                            out[code] = text(to[k]) if k < len(to) else ""
                        else:
                            out[code] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + k & 0xFFFF).to_bytes(2, "big"))
        return sorted(sizes) or [1], out

    def page_text(self, page: dict) -> str:
        contents = page.get("Contents")
        return self.text_in(self.stream(contents) if isinstance(contents, (Reference, list)) else b"", page.get("Resources"))

    def form_text(self, form: object, above: object) -> str:
        """Text of a form that page contents draw; one that draws itself adds nothing there."""
        if not isinstance(form, Reference):
            return ""
        if form not in self.forms:
            self.forms[form] = ""
            head = self.get(form)
            if isinstance(head, dict) and head.get("Subtype") == "Form":
                self.forms[form] = self.text_in(self.stream(form), head.get("Resources", above))
        return self.forms[form]

    def text_in(self, content: bytes, given: object) -> str:
        resources = self.get(given)
        fonts, drawn = ((self.get(resources.get(k)) if isinstance(resources, dict) else None) or {} for k in ("Font", "XObject"))
        lines, line, stack, font, y, size = [], [], [], None, None, 0

        def shown(raw: object) -> None:
            if isinstance(raw, bytes):
                line.append(self.reader(fonts.get(font))(raw))

        def ended() -> None:
            if "".join(line).strip():
                lines.append(" ".join("".join(line).split()))
            line.clear()

        for value, _ in parse(content):
            if not isinstance(value, Word):
                stack.append(value)
                continue
            op = bytes(value)
            if op == b"Tf" and len(stack) >= 2:
                font = str(stack[-2])
            elif op == b"Tj" and stack:
                shown(stack[-1])
            elif op == b"TJ" and stack and isinstance(stack[-1], list):
                for x in stack[-1]:
                    if isinstance(x, bytes):
                        shown(x)
                    elif isinstance(x, (int, float)) and x < -180:  # thousandths of the font's size: a gap between words
                        line.append(" ")
            elif op in (b"'", b'"', b"T*"):
                ended()
                if op != b"T*" and stack:
                    shown(stack[-1])
            elif op in (b"Td", b"TD") and len(stack) >= 2:
                ended() if stack[-1] else line.append(" ")
            elif op == b"Tm" and len(stack) >= 6:
                ended() if y is not None and stack[-1] != y else line.append(" ")
                y = stack[-1]
            elif op == b"ET":
                line.append(" ")
            elif op == b"Do" and stack and isinstance(stack[-1], Name):
                inner = self.form_text(drawn.get(stack[-1]), given)
                if inner:
                    ended()
                    lines.append(inner)
                    size += len(inner)
                    if size > MOST_BYTES:
                        raise ValueError("forms draw too much text")
            stack.clear()
        ended()
        return "\n".join(lines)


def text_of(data: bytes | None) -> str | None:
    """Text of a PDF file, pages apart by blank lines; null where there is none or the file is damaged."""
    if not data or b"%PDF" not in data[:1024]:
        return None
    try:
        document = Document(data)
        pages = [document.page_text(p) for p in document.pages()]
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, zlib.error):
        return None
    return "\n\n".join(p for p in pages if p.strip()).strip() or None


def extracted(pages: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """(key, content): the text of PDF files in a binary column, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(x) for x in batch.column(1).to_pylist()], pa.string())], [key, "content"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, body).mapInArrow(run, f"`{key}` {kind}, content string")
