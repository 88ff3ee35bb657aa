"""Lossless WebP (VP8L): a decoder for the whole bitstream, and encoders.

``decode`` reads prefix codes (simple and normal, with entropy-image groups), literals,
back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green and
palette transforms.

Symbols have no fixed places in a stream.  ``read_symbols`` therefore decodes a symbol at every bit position at once,
as arrays, and then follows the chain of those that are real; ``read_plain`` reads one symbol after the other.  Both
give the same pixels; the second serves several groups of codes and streams that the first does not cover.

``encode`` writes one image with any of the features; ``write_grey`` writes many grey images together: their
back-references, prefix codes and bits are computed as arrays.  What is stored of a payload is grey samples, a byte
each, in rows of ``ROW``; ``KINDS`` of features take turns by the payload's CRC, so that reading meets all of them:
subtract-green with a palette (several samples a pixel where there are few colours), the colour cache,
cross-colour, and the best of some predictors with subtract-green; back-references in all of them.
Pixels are uint8 arrays (height, width, 4) in RGBA order.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common, tokens

# Fixed values of the format: order of code length codes, and the distances of the 120 near-pixel codes.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_MULTIPLIER, MAX_SIDE, CODES = 0x1E35A7BD, 16384, (256 + 24, 256, 256, 256, 40)
#: Numbers of 15 bits in reverse order.
REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.uint32)
TURNED = [(REVERSED[: 1 << n] >> (15 - n)).astype(np.intp) for n in range(16)]
#: Distances that the near-pixel codes stand for, by the width of the image: dx + dy * width.
NEAR_X, NEAR_Y = (np.array([0, *v]) for v in zip(*NEAR, strict=True))
#: Samples in a row, rows of an image (back-references then reach all of it), samples whose images are written together.
ROW, ROWS, TOGETHER = 64, 16_000, 1 << 20
KINDS = PALETTED, CACHED, CROSSED, PREDICTED = range(4)
#: Bits of the stored images' colour cache; bytes that a back-reference must match; the longest one.
CACHE_BITS, MATCH, LONGEST = 8, 6, 4096
#: Predictors that need only the row above and the pixel to the left: these are inverted as arrays.
BY_ROWS = (0, 1, 2, 3, 4, 8, 9)


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        """The next bits; zeros after the end."""
        first, shift = divmod(self.at, 8)
        return (int.from_bytes(self.data[first : first + 4], "little") >> shift) & ((1 << n) - 1)

    def ahead(self, at: int, n: int) -> tuple[int, int]:
        """At least ``n`` bits from bit ``at`` on, zeros after the end; (value, number of bits)."""
        first, shift = divmod(at, 8)
        return (int.from_bytes(self.data[first : first + n // 8 + 2], "little") >> shift) & ((1 << n) - 1), n

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image data end too early")

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value


class Writer:
    """Writes bits, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def fields(self, fields: list[tuple[int, int]]) -> None:
        for value, n in fields:
            self.write(int(value), n)

    def done(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, number of bits)."""
    out, code, before = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[symbol] = (int(REVERSED[code]) >> (15 - n), n)
        code += 1
    return out


class Code:
    """A prefix code ready for reading, from (bits << 16 | symbol) of its symbols.

    ``table`` has (symbol << 8 | bits) for each value of the next ``most`` bits."""

    def __init__(self, used: list[int]):
        if not used:
            raise ValueError("an empty prefix code")
        self.single = used[0] & 0xFFFF if len(used) == 1 else None
        self.most, self.table = 0, None
        if self.single is None:
            used.sort()
            both = np.array(used, np.int32)
            self.most, bits = used[-1] >> 16, both >> 16
            values = np.repeat((both & 0xFFFF) << 8 | bits, 1 << (self.most - bits))  # so many begin with each code, in the order of codes
            if len(values) != 1 << self.most:
                raise ValueError("an incomplete prefix code")
            self.table = np.empty(1 << self.most, np.int32)
            self.table[TURNED[self.most]] = values

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        found = int(self.table[bits.peek(self.most)])
        bits.skip(found & 255)
        return found >> 8


@lru_cache(maxsize=256)
def inner_code(n: int, numbers: int) -> tuple[list[int], int, bool]:
    """(table, mask, whether a 0 bit is the length 0) of the code that lengths are written in, from its ``n`` lengths of three bits."""
    lengths = [0] * 19
    for i in range(n):
        lengths[CODE_ORDER[i]] = numbers >> 3 * i & 7
    code = Code([n << 16 | s for s, n in enumerate(lengths) if n])
    if code.single is not None:
        return [code.single << 8], 0, False
    table = code.table.tolist()
    return table, len(table) - 1, all(x == 1 for x in table[::2])


def read_code(bits: Bits, size: int) -> Code:
    v = bits.peek(19)
    if v & 1:  # one or two symbols, the first in one bit or eight
        two, n = v >> 1 & 1, 8 if v & 4 else 1
        bits.skip(3 + n + 8 * two)
        used = {v >> 3 & ((1 << n) - 1)}
        if two:
            used.add(v >> 3 + n & 0xFF)
        if max(used) >= size:
            raise ValueError("a symbol out of its alphabet")
        return Code([1 << 16 | s for s in used])
    bits.skip(1)
    n = 4 + bits.read(4)
    table, mask, zeros = inner_code(n, bits.ahead(bits.at, 3 * n)[0])
    bits.skip(3 * n)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    used, at, last, value, have, start = [], 0, 8, 0, 0, bits.at
    while at < size and left:
        if have < 16:  # refill
            value, have = bits.ahead(start, 512)
        if zeros and not value & 1:
            n = min((value & -value).bit_length() - 1 if value else have, have, size - at, left)
            value, have, start, at, left = value >> n, have - n, start + n, at + n, left - n
            continue
        left -= 1
        found = table[value & mask]
        n, s = found & 255, found >> 8
        value, have, start = value >> n, have - n, start + n
        if s < 16:
            if s:
                used.append(s << 16 | at)
                last = s
            at += 1
            continue
        extra, base = (2, 3) if s == 16 else (3, 3) if s == 17 else (7, 11)
        n = base + (value & ((1 << extra) - 1))
        value, have, start = value >> extra, have - extra, start + extra
        if at + n > size:
            raise ValueError("code lengths run over their alphabet")
        if s == 16:
            used += [last << 16 | k for k in range(at, at + n)]
        at += n
    bits.at = start
    bits.skip(0)
    return Code(used)


def write_code(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(1, 1)
        for s in used:
            out.write(s, 8)
        return
    runs, at = [], 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at]:
            n += 1
        if lengths[at] == 0 and n >= 3:
            n = min(n, 138)
            runs.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif n >= 4:
            n = min(n, 7)
            runs += [(lengths[at], 0, 0), (16, n - 4, 2)]
        else:
            n = 1
            runs.append((lengths[at], 0, 0))
        at += n
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    inner = limited_lengths(counts, 7)
    codes = canonical(inner)
    single = sum(1 for n in inner if n) == 1
    n = max(4, max(i for i in range(19) if inner[CODE_ORDER[i]]) + 1)
    out.write(0, 1)
    out.write(n - 4, 4)
    for i in range(n):
        out.write(inner[CODE_ORDER[i]], 3)
    out.write(0, 1)
    for s, extra, width in runs:
        if not single:
            out.write(*codes[s])
        out.write(extra, width)


def limited_lengths(counts: list[int], most: int) -> list[int]:
    """Prefix code lengths of at most ``most`` bits: Huffman over counts raised until none is longer."""
    floor = 1
    while True:
        heap = [(max(c, floor), s, (s,)) for s, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (*a[2], *b[2])))
        if max(lengths, default=0) <= most:
            return lengths
        floor *= 4


# ---------------------------------------------------------------- transforms


def tiles(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def lanes(v: int) -> tuple[int, int, int, int]:
    return v >> 24, (v >> 16) & 255, (v >> 8) & 255, v & 255


def joined(a: int, r: int, g: int, b: int) -> int:
    return a << 24 | r << 16 | g << 8 | b


def clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predicted(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    """The predictor of a pixel, by mode 0 to 13 of the format."""
    if mode == 11:
        a, b = 0, 0
        for x, y, z in zip(lanes(left), lanes(top), lanes(top_left), strict=True):
            a, b = a + abs(y - z), b + abs(x - z)
        return left if a < b else top
    if mode == 12:
        return joined(*(clamp(x + y - z) for x, y, z in zip(lanes(left), lanes(top), lanes(top_left), strict=True)))
    if mode == 13:
        out = []
        for m, z in zip(lanes(average(left, top)), lanes(top_left), strict=True):
            out.append(clamp(m + int((m - z) / 2)))
        return joined(*out)
    return (
        lambda: 0xFF000000,
        lambda: left,
        lambda: top,
        lambda: top_right,
        lambda: top_left,
        lambda: average(average(left, top_right), top),
        lambda: average(left, top_left),
        lambda: average(left, top),
        lambda: average(top_left, top),
        lambda: average(top, top_right),
        lambda: average(average(left, top_left), average(top, top_right)),
    )[mode if mode < 11 else 0]()


def added(a: int, b: int) -> int:
    return (((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00) | (((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF)


def subtracted(a: int, b: int) -> int:
    return joined(*((x - y) & 255 for x, y in zip(lanes(a), lanes(b), strict=True)))


def prediction(pixels: list[int], i: int, w: int, modes: list[int], bits: int) -> int:
    y, x = divmod(i, w)
    if not i:
        return 0xFF000000
    if not y:
        return pixels[i - 1]
    if not x:
        return pixels[i - w]
    mode = (modes[(y >> bits) * tiles(w, bits) + (x >> bits)] >> 8) & 15
    return predicted(mode, pixels[i - 1], pixels[i - w], pixels[i - w - 1], pixels[i - w + 1])


def undo_predictor(pixels: list[int], w: int, modes: list[int], bits: int) -> list[int]:
    out: list[int] = []
    for i, v in enumerate(pixels):
        out.append(added(v, prediction(out, i, w, modes, bits)))
    return out


def signed(v: int) -> int:
    return v - 256 if v > 127 else v


def cross(v: int, element: int, sign: int) -> int:
    """Apply (sign -1) or undo (1) the cross-colour transform of one pixel."""
    a, r, g, b = lanes(v)
    _, red_to_blue, green_to_blue, green_to_red = (signed(x) for x in lanes(element))
    green = signed(g)
    new_red = (r + sign * ((green_to_red * green) >> 5)) & 255
    red = signed(new_red if sign > 0 else r)
    new_blue = (b + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * red) >> 5))) & 255
    return joined(a, new_red, g, new_blue)


def crossed(pixels: list[int], w: int, elements: list[int], bits: int, sign: int) -> list[int]:
    per = tiles(w, bits)
    return [cross(v, elements[(i // w >> bits) * per + (i % w >> bits)], sign) for i, v in enumerate(pixels)]


def green(pixels: list[int], sign: int) -> list[int]:
    return [joined(v >> 24, ((v >> 16) + sign * (v >> 8)) & 255, (v >> 8) & 255, (v + sign * (v >> 8)) & 255) for v in pixels]


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# ---------------------------------------------------------------- decoding


def length_or_distance(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


class Pixels:
    """ARGB numbers as indexes into colours, or whole where ``index`` is None.

    What is done to each pixel for itself is done to the colours."""

    def __init__(self, colours: np.ndarray, index: np.ndarray | None = None):
        self.colours, self.index = colours, index

    def each(self, f) -> Pixels:
        return Pixels(f(self.colours), self.index)

    def whole(self) -> np.ndarray:
        return self.colours if self.index is None else self.colours[self.index]


def read_image(bits: Bits, w: int, h: int, top: bool) -> np.ndarray | Pixels:
    """ARGB numbers of an entropy-coded image; as ``Pixels`` for the last image of a stream (``top``)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    groups, meta, meta_bits = 1, None, 0
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (read_image(bits, tiles(w, meta_bits), tiles(h, meta_bits), False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (CODES[0] + (1 << cache_bits if cache_bits else 0), *CODES[1:])
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1:
        g, r, b, a = (c.single for c in codes[0][:4])
        if None not in (g, r, b, a) and g < 256:
            out = np.full(w * h, joined(a, r, g, b), np.uint32)
            return Pixels(out) if top else out
        if g is None and (out := read_symbols(bits, w, w * h, codes[0], cache_bits)) is not None:
            return out if top else out.whole()
    out = np.array(read_plain(bits, w, h, codes, meta, meta_bits, cache_bits), np.uint32)
    return Pixels(out) if top else out


def read_plain(bits: Bits, w: int, h: int, codes: list[list[Code]], meta: list[int] | None, meta_bits: int, cache_bits: int) -> list[int]:
    """ARGB numbers, one symbol after the other."""
    cache, out, total = [0] * (1 << cache_bits), [], w * h
    per, shift = tiles(w, meta_bits), 32 - cache_bits
    while (at := len(out)) < total:
        group = codes[meta[(at // w >> meta_bits) * per + (at % w >> meta_bits)] if meta else 0]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = (group[k].read(bits) for k in (1, 2, 3))
            out.append(joined(a, r, s, b))
        elif s < 280:
            n, far = length_or_distance(bits, s - 256), length_or_distance(bits, group[4].read(bits))
            far = far - 120 if far > 120 else max(1, int(NEAR_X[far] + NEAR_Y[far] * w))
            if far > at or at + n > total:
                raise ValueError("a back-reference out of the image")
            for _ in range(n):
                out.append(out[-far])
        else:
            out.append(cache[s - 280])
        if cache_bits:
            for v in out[at:]:
                cache[(v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = v
    return out


class Windows:
    """The next bits at some bit positions, from the numbers of four bytes at each byte."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] >> (at & 7).astype(np.uint32)


def taken(code: Code, windows: Windows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) that a code has at bit positions."""
    if code.single is not None:
        return np.full(len(at), code.single, np.int32), np.zeros(len(at), np.int32)
    found = code.table[windows[at] & np.uint32((1 << code.most) - 1)]
    return found >> 8, found & 255


#: Extra bits of length and distance symbols, and the least numbers that they stand for.
EXTRA = np.array([0, 0, 0, 0, *[(s - 2) >> 1 for s in range(4, 40)]], np.int32)
NUMBER = np.array([1, 2, 3, 4, *[((2 + s % 2) << ((s - 2) >> 1)) + 1 for s in range(4, 40)]], np.int64)


def numbers(symbol: np.ndarray, windows: Windows, at: np.ndarray) -> np.ndarray:
    """What length or distance symbols stand for, whose extra bits are at ``at``."""
    return NUMBER[symbol] + (windows[at] & ((np.uint32(1) << EXTRA[symbol].astype(np.uint32)) - np.uint32(1)))


def read_symbols(bits: Bits, w: int, total: int, codes: list[Code], cache_bits: int) -> Pixels | None:
    """``read_plain`` for one group of codes; None where it does not apply."""
    first, shift = divmod(bits.at, 8)
    raw = bits.data[first : first + 8 * total + 1]  # a pixel takes 60 bits at most
    size = 8 * len(raw)
    words = np.ndarray(len(raw) + 9, "<u4", raw + bytes(12), strides=(1,))
    # The next bits at every position.  A symbol with all its parts has at most 2 * 15 + 28 bits: what passes the end stays inside.
    windows = Windows(words)
    top = 8 * len(words) - 1
    index = words[: len(raw), None].astype(np.intp) >> np.arange(8)
    index &= (1 << codes[0].most) - 1
    found = np.take(codes[0].table, index.ravel(), mode="clip")
    del index
    follow = np.arange(size + 1, dtype=np.int32)
    follow[:-1] += found & 255
    flat = all(c.single is not None for c in codes[1:4])
    if not flat:
        at = np.flatnonzero(found < 256 << 8)
        to = follow[at]
        for c in codes[1:4]:
            to = np.minimum(to + taken(c, windows, to)[1], top)
        follow[at] = to
    at = np.flatnonzero(found >= 256 << 8)
    if cache_bits:
        at = at[found[at] < 280 << 8]
    to = np.minimum(follow[at] + EXTRA[(found[at] >> 8) - 256], top)
    far, n = taken(codes[4], windows, to)
    follow[at] = to + n + EXTRA[far]
    # The chain of real symbols.
    two = np.take(follow, follow, mode="clip")
    step, chain, now = memoryview(np.take(two, two, mode="clip")), array("i"), shift  # every fourth one
    add = chain.append
    while now < size:
        add(now)
        now = step[now]
    chain = np.frombuffer(chain, np.int32)
    chain = np.stack([chain, two[chain]], 1).ravel()
    chain = np.stack([chain, np.take(follow, chain, mode="clip")], 1).ravel()
    chain = chain[: int(np.searchsorted(chain, size))]
    found = found[chain]
    symbol, behind = found >> 8, np.minimum(chain + (found & 255), top)
    count = np.ones(len(chain), np.int64)
    copies = np.flatnonzero((found >= 256 << 8) & (found < 280 << 8))
    count[copies] = numbers(symbol[copies] - 256, windows, behind[copies])
    ends = np.cumsum(count)
    k = int(np.searchsorted(ends, total)) + 1
    if k > len(chain) or follow[chain[k - 1]] > size:
        raise ValueError("the image data end too early")
    if ends[k - 1] != total:
        raise ValueError("a back-reference out of the image")
    after = 8 * first + int(follow[chain[k - 1]])
    symbol, behind, count, starts, copies = symbol[:k], behind[:k], count[:k], (ends - count)[:k], copies[copies < k]
    to = np.minimum(behind[copies] + EXTRA[symbol[copies] - 256], top)
    far, n = taken(codes[4], windows, to)
    far = numbers(far, windows, np.minimum(to + n, top))
    near = np.minimum(far, 120)
    far = np.where(far > 120, far - 120, np.maximum(1, NEAR_X[near] + NEAR_Y[near] * w))
    if (far > starts[copies]).any():
        raise ValueError("a back-reference out of the image")
    literal = np.flatnonzero(symbol < 256)
    if flat and not cache_bits:  # all that differs is green
        r, b, a = (c.single for c in codes[1:4])
        colours, index = np.arange(256, dtype=np.uint32) << np.uint32(8) | np.uint32(joined(a, r, 0, b)), symbol[literal]
    else:
        value, to = symbol[literal].astype(np.uint32) << np.uint32(8), behind[literal]
        for c, place in zip(codes[1:4], (16, 0, 24), strict=True):
            part, n = taken(c, windows, to)
            value |= part.astype(np.uint32) << np.uint32(place)
            to = np.minimum(to + n, top)
        colours, index = np.unique(np.append(value, np.uint32(0)) if cache_bits else value, return_inverse=True)
    if (out := resolved(total, symbol, starts, count, literal, colours, index, copies, far, cache_bits)) is not None:
        bits.at = after
    return out


def resolved(total: int, symbol: np.ndarray, starts: np.ndarray, count: np.ndarray, literal: np.ndarray, colours: np.ndarray, index: np.ndarray, copies: np.ndarray, far: np.ndarray, cache_bits: int) -> Pixels | None:
    """Pixels from symbols: literals (their ``index`` among the ``colours``), then copies and what the colour cache holds, in order.

    Every pixel is one of the literal colours (or 0, which the cache holds at first; it has the last index).  A slot of
    the cache that only one of these colours has needs no record of what was written to it; the others are kept up to date."""
    out = bytearray(total) if len(colours) <= 256 else array("I", bytes(4 * total))
    view = np.frombuffer(out, np.uint8 if len(colours) <= 256 else np.uint32)
    view[starts[literal]] = index[: len(literal)]
    events, cached = list(zip(starts[copies].tolist(), count[copies].tolist(), far.tolist(), strict=True)), np.flatnonzero(symbol >= 280)
    slot_of, shared = [], b""
    if len(cached):
        slots = (colours * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)
        found, several = np.unique(slots, return_counts=True)
        want = symbol[cached] - 280
        if len(colours) > 256 or not np.isin(want, found).all():
            return None
        # Slots with one colour: it must have been seen, as a literal, before.
        seen = np.full(len(colours), total)
        np.minimum.at(seen, index[: len(literal)], starts[literal])
        seen[index[-1]] = -1 if slots[index[-1]] == 0 else seen[index[-1]]
        place = np.searchsorted(found, want)
        alone = several[place] == 1
        only = np.zeros(len(found), np.int64)
        only[np.searchsorted(found, slots)] = np.arange(len(colours))
        if (seen[only[place[alone]]] > starts[cached[alone]]).any():
            return None
        view[starts[cached[alone]]] = only[place[alone]]
        tight = np.isin(slots, found[several > 1])
        if tight.any():
            shared = bytes(np.flatnonzero(~tight).astype(np.uint8))
            slot_of = slots.tolist()
            mine = literal[tight[index[: len(literal)]]]
            events += [(s, 0, -1) for s in starts[mine].tolist()]
            events += [(s, 0, -2 - x) for s, x in zip(starts[cached[~alone]].tolist(), want[~alone].tolist(), strict=True)]
            events.sort()
    del view
    now: dict[int, int] = {}
    zero = int(index[-1]) if cache_bits else 0
    for at, n, back in events:
        if n:
            low = at - back
            if n <= back:
                out[at : at + n] = part = out[low : low + n]
            else:
                part = (out[low:at] * (n // back + 1))[:n]
                out[at : at + n] = part
            if slot_of:
                for x in part.translate(None, shared):
                    now[slot_of[x]] = x
        elif back == -1:
            now[slot_of[out[at]]] = out[at]
        else:
            out[at] = now.get(-2 - back, zero)
    return Pixels(colours, np.frombuffer(out, np.uint8 if isinstance(out, bytearray) else np.uint32))


def listed(pixels: np.ndarray) -> list[int]:
    x = pixels.reshape(-1, 4).astype(np.uint32)
    return (x[:, 3] << 24 | x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]).tolist()


def undo_green(pixels: np.ndarray) -> np.ndarray:
    g = pixels >> np.uint32(8) & np.uint32(0xFF)
    return pixels & np.uint32(0xFF00FF00) | (pixels & np.uint32(0x00FF00FF)) + (g << np.uint32(16) | g) & np.uint32(0x00FF00FF)


def undo_cross(pixels: np.ndarray, w: int, elements: np.ndarray, bits: int) -> np.ndarray:
    at = np.arange(len(pixels)) if len(elements) > 1 else 0
    e = elements[(at // w >> bits) * tiles(w, bits) + (at % w >> bits)]
    number = lambda v, k: (v >> np.uint32(k)).astype(np.uint8).view(np.int8).astype(np.int32)
    green_, red_to_blue, green_to_blue, green_to_red = number(pixels, 8), *(number(np.atleast_1d(e), k) for k in (16, 8, 0))
    red = (number(pixels, 16) + (green_to_red * green_ >> 5)).astype(np.int8)
    blue = (number(pixels, 0) + (green_to_blue * green_ >> 5) + (red_to_blue * red >> 5)).astype(np.uint8)
    return pixels & np.uint32(0xFF00FF00) | red.view(np.uint8).astype(np.uint32) << np.uint32(16) | blue


def undo_palette(pixels: np.ndarray, width: int, packed: int, palette: np.ndarray, bits: int) -> np.ndarray:
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    index = (pixels >> np.uint32(8) & np.uint32(0xFF)).reshape(-1, packed)
    if bits:
        per, n = 1 << bits, 8 >> bits
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(n)) & np.uint32((1 << n) - 1)).reshape(-1, packed * per)[:, :width]
    return table[index].ravel()


def halved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def undo_prediction(pixels: np.ndarray, w: int, tile: np.ndarray, bits: int) -> np.ndarray:
    per = tiles(w, bits)
    modes = (tile >> np.uint32(8) & np.uint32(15)).reshape(-1, per)
    if not np.isin(modes, BY_ROWS).all():
        return np.array(undo_predictor(pixels.tolist(), w, tile.tolist(), bits), np.uint32)
    out = np.ascontiguousarray(pixels).view(np.uint8).reshape(-1, 4 * w).copy()
    first = out[0].reshape(w, 4)
    first[0, 3] += 255
    np.cumsum(first, axis=0, dtype=np.uint8, out=first)
    rows, above = modes.tolist(), out[0]
    for y in range(1, len(out)):  # four bytes a pixel
        row = out[y]
        row[:4] += above[:4]
        for k, mode in enumerate(rows[y >> bits]):
            a, b = 4 * max(1, k << bits), 4 * min(w, (k + 1) << bits)
            if mode == 9 or mode == 3:
                right = above[a + 4 : b + 4] if b < 4 * w else np.concatenate((above[a + 4 :], row[:4]))
                row[a:b] += right if mode == 3 else halved(above[a:b], right)
            elif mode == 8:
                row[a:b] += halved(above[a - 4 : b - 4], above[a:b])
            elif mode == 2:
                row[a:b] += above[a:b]
            elif mode == 4:
                row[a:b] += above[a - 4 : b - 4]
            elif mode == 1:
                part = row[a - 4 : b].reshape(-1, 4)
                np.cumsum(part, axis=0, dtype=np.uint8, out=part)
            else:
                row[a + 3 : b : 4] += 255
        above = row
    return out.reshape(-1).view(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """The RGBA pixels of a RIFF file with one VP8L chunk; ValueError if it is damaged."""
    return np.ascontiguousarray(decode_pixels(data).whole()).view(np.uint8).reshape(*shape_of(data), 4)[:, :, [2, 1, 0, 3]]


def shape_of(data: bytes) -> tuple[int, int]:
    """Height and width."""
    n = int.from_bytes(data[21:25], "little")
    return (n >> 14 & 0x3FFF) + 1, (n & 0x3FFF) + 1


def decode_pixels(data: bytes) -> Pixels:
    """All pixels in a row."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if len(data) < 20 + size:
        raise ValueError("the image data end too early")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, packed = [], w
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, _ in undo):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS):
            size_bits = bits.read(3) + 2
            image = read_image(bits, tiles(packed, size_bits), tiles(h, size_bits), False)
            step = undo_prediction if kind == PREDICTOR else undo_cross
            alone = kind == CROSS and len(image) == 1
            undo.append((kind, lambda p, f=step, a=(packed, image, size_bits), alone=alone: p.each(lambda x: f(x, *a)) if alone else Pixels(f(p.whole(), *a))))
        elif kind == GREEN:
            undo.append((kind, lambda p: p.each(undo_green)))
        else:
            n = bits.read(8) + 1
            palette = read_image(bits, n, 1, False)
            palette = np.cumsum(np.ascontiguousarray(palette).view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            wide, size_bits = packed, bundle_bits(n)
            packed = tiles(wide, size_bits)
            undo.append((kind, lambda p, a=(wide, packed, palette, size_bits): Pixels(undo_palette(p.whole(), *a)) if a[3] else p.each(lambda x: undo_palette(x, 1, 1, *a[2:]))))
    pixels = read_image(bits, packed, h, True)
    for _, step in reversed(undo):
        pixels = step(pixels)
    return pixels


# ---------------------------------------------------------------- encoding


def riff(body: bytes) -> bytes:
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def header(w: int, h: int) -> Writer:
    out = Writer()
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.write(value, n)
    return out


def symbol_of(v: int) -> tuple[int, int, int]:
    """Length or distance -> (prefix symbol, extra bits' value, their number)."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def write_image(out: Writer, pixels: list[int], w: int, cache_bits: int, references: bool, top: bool) -> None:
    items, at, seen, cache = [], 0, {}, [None] * (1 << cache_bits)
    while at < len(pixels):
        n = far = 0
        if references and (before := seen.get(tuple(pixels[at : at + 3]))) is not None and at + 3 <= len(pixels):
            far = at - before
            while at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[at + n - far]:
                n += 1
        if n >= 3:
            s, d = symbol_of(n), symbol_of(far + 120)
            if far == w:
                d = symbol_of(1)
            items.append((256 + s[0], s[1:], d))
        else:
            v, n = pixels[at], 1
            slot = (v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache[slot] == v:
                items.append((280 + slot, None, None))
            else:
                items.append((v >> 8 & 255, (v >> 16 & 255, v & 255, v >> 24), None))
        for i in range(at, at + n):
            seen[tuple(pixels[i : i + 3])] = i
            if cache_bits:
                cache[(pixels[i] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
        at += n
    out.write(cache_bits > 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if top:
        out.write(0, 1)
    counts = [[0] * n for n in (CODES[0] + (1 << cache_bits if cache_bits else 0), *CODES[1:])]
    for s, more, far in items:
        counts[0][s] += 1
        if s < 256:
            for k in range(3):
                counts[k + 1][more[k]] += 1
        elif far:
            counts[4][far[0]] += 1
    lengths = [limited_lengths(c, 15) for c in counts]
    for x in lengths:
        write_code(out, x)
    codes = [canonical(x) if sum(n > 0 for n in x) > 1 else {} for x in lengths]

    def put(k: int, s: int) -> None:
        if codes[k]:
            out.write(*codes[k][s])

    for s, more, far in items:
        put(0, s)
        if s < 256:
            for k in range(3):
                put(k + 1, more[k])
        elif far:
            out.write(*more)
            put(4, far[0])
            out.write(*far[1:])


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = True, tile_bits: int = 2) -> bytes:
    """A VP8L file that uses the given transforms (in that order), colour cache and back-references."""
    h, w = pixels.shape[:2]
    out, values, packed = header(w, h), listed(pixels), w
    for kind in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        if kind == GREEN:
            values = green(values, -1)
        elif kind == PALETTE:
            palette = sorted(set(values))
            if len(palette) > 256:
                raise ValueError("more than 256 colours")
            bits, index = bundle_bits(len(palette)), {v: i for i, v in enumerate(palette)}
            out.write(len(palette) - 1, 8)
            write_image(out, [palette[0], *(subtracted(b, a) for a, b in zip(palette, palette[1:], strict=False))], len(palette), 0, False, False)
            rows = []
            for y in range(h):
                row = [0] * tiles(packed, bits)
                for x in range(packed):
                    row[x >> bits] |= index[values[y * packed + x]] << (x % (1 << bits) * (8 >> bits))
                rows += [0xFF000000 | v << 8 for v in row]
            values, packed = rows, tiles(packed, bits)
        else:
            n = tiles(packed, tile_bits) * tiles(h, tile_bits)
            out.write(tile_bits - 2, 3)
            image = [0xFF000000 | (i % 14) << 8 for i in range(n)] if kind == PREDICTOR else [0xFF000000 | (i * 37 & 255) << 16 | (i * 11 & 255) << 8 | (i * 5 & 255) for i in range(n)]
            write_image(out, image, tiles(packed, tile_bits), 0, False, False)
            if kind == PREDICTOR:
                values = [subtracted(v, prediction(values, i, packed, image, tile_bits)) for i, v in enumerate(values)]
            else:
                values = crossed(values, packed, image, tile_bits, -1)
    out.write(0, 1)
    write_image(out, values, packed, cache_bits, references, True)
    return riff(out.done())


# ---------------------------------------------------------------- many grey images

#: Code lengths of the stored images are written with this fixed code: zeros in one bit, 6 in four, the others in five.
LENGTH_BITS = np.array([1, 5, 5, 5, 5, 5, 4, *[5] * 9])
LENGTH_CODES = np.array([canonical(LENGTH_BITS.tolist())[i][0] for i in range(16)], np.uint64)


def simple(*symbols: int) -> tuple[int, int]:
    """A simple prefix code of one or two symbols: (value, bits)."""
    return (5 | symbols[0] << 3, 11) if len(symbols) == 1 else (7 | symbols[0] << 3 | symbols[1] << 11, 19)


def pack(words: np.ndarray, values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> None:
    """Put values of up to 58 bits into 64-bit words at ascending bit positions."""
    use = np.flatnonzero(sizes)
    if not len(use):
        return
    v, n, at = values[use].astype(np.uint64), sizes[use], at[use]
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    edges = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[edges]] |= np.bitwise_or.reduceat(v << shift, edges)
    over = np.flatnonzero((at & 63) + n > 64)
    words[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths [n, symbols] of complete prefix codes for rows of counts; 0 where a row has fewer than two symbols.

    Lengths are the symbols' information rounded up; what that leaves free goes to the most frequent symbols
    that it is enough for, until the code is complete."""
    several = (counts > 0).sum(1) > 1
    counts = np.where(several[:, None], counts, 0)
    floor = np.where(counts > 0, np.maximum(counts, counts.sum(1, keepdims=True) / (1 << 14)), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.ceil(-np.log2(floor / floor.sum(1, keepdims=True)) - 1e-9)
    out = np.where(counts > 0, np.clip(np.nan_to_num(bits, posinf=0, neginf=0), 1, 15), 0).astype(np.int64)
    left = np.where(several, (1 << 15) - np.where(out > 0, 1 << (15 - out), 0).sum(1), 0)
    if not several.any():
        return out
    order = np.argsort(-counts, axis=1, kind="stable")[:, : int((counts > 0).sum(1).max())]
    row = np.arange(len(out))
    while left.any():
        for s in order.T:
            n = out[row, s]
            gain = np.where(n > 1, 1 << (15 - n), 1 << 16)
            can = gain <= left
            out[row, s] -= can
            left -= np.where(can, gain, 0)
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The codes [n, symbols] of ``lengths``, first bit lowest."""
    out, code = np.zeros(lengths.shape, np.int64), np.zeros((len(lengths), 1), np.int64)
    for n in range(1, 16):
        mine = lengths == n
        code = code << 1
        out += np.where(mine, REVERSED[np.minimum(code + np.cumsum(mine, 1) - 1, (1 << n) - 1).clip(0) << (15 - n)], 0)
        code = code + mine.sum(1, keepdims=True)
    return out.astype(np.uint64)


def code_fields(lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) [n, symbols + 2] of what describes the codes in a stream."""
    head = n = 0
    for value, size in ((0, 1), (15, 4), *((int(LENGTH_BITS[s]) if s < 16 else 0, 3) for s in CODE_ORDER), (0, 1)):
        head, n = head | value << n, n + size
    values = np.zeros((len(lengths), lengths.shape[1] + 2), np.uint64)
    sizes = np.zeros(values.shape, np.int64)
    normal = lengths.any(1)
    values[:, 0], sizes[:, 0] = np.where(normal, head & 0xFFFFFFFF, 5 | counts.argmax(1) << 3), np.where(normal, 32, 11)
    values[:, 1], sizes[:, 1] = np.where(normal, head >> 32, 0), np.where(normal, n - 32, 0)
    values[:, 2:] = np.where(normal[:, None], LENGTH_CODES[lengths], 0)
    sizes[:, 2:] = np.where(normal[:, None], LENGTH_BITS[lengths], 0)
    return values, sizes


def back_references(data: np.ndarray, image: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of the match with the last place of the same ``MATCH`` samples of the image; length 1 if none.

    As long as the distance stays the same from sample to sample, one match goes on."""
    n = len(data)
    key = np.ndarray(n, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,)) & np.uint64((1 << 8 * MATCH) - 1)
    key |= image.astype(np.uint64) << np.uint64(8 * MATCH)
    whole = np.ones(n, bool)
    whole[np.maximum(ends[:, None] - np.arange(1, MATCH), 0)] = False  # (the first sample of all has nothing before it)
    whole = np.flatnonzero(whole)
    order = key[whole] * np.uint64(0x9E3779B97F4A7C15)
    order &= ~np.uint64((1 << 22) - 1)
    order |= whole.view(np.uint64)
    order.sort()
    place = (order & np.uint64((1 << 22) - 1)).astype(np.int32)
    del order
    ordered = key[place]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    back = np.zeros(n, np.int32)
    later = place[same + 1]
    back[later] = later - place[same]
    edges = np.append(np.flatnonzero(back[1:] != back[:-1]) + 1, n).astype(np.int32)
    length = np.repeat(edges, np.diff(edges, prepend=0))
    length -= np.arange(1 - MATCH, n + 1 - MATCH, dtype=np.int32)
    np.minimum(length, LONGEST, out=length)
    length[back == 0] = 1
    return length, back


def prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``symbol_of`` for arrays."""
    v = v - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    n = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1)), v & ((1 << n) - 1), n


def entropy_coded(streams: list[np.ndarray], prefixes: list[tuple[int, int]], widths: list[int], rest: tuple[int, int], cache: bool) -> list[bytes]:
    """Bodies of files: what comes before (value, bits), then the main image of the samples of each stream.

    Samples are the green values; without a cache red and blue are 0, and ``rest`` describes the codes of red, blue and
    alpha.  With one, pixels are grey, and those that the cache holds take its symbols."""
    sizes = np.array([len(s) for s in streams])
    ends, image, data = np.cumsum(sizes), np.repeat(np.arange(len(streams), dtype=np.int32), sizes), np.concatenate(streams)
    length, back = back_references(data, image, ends)
    # Only the matches that are used are gone through; samples that none covers are literals.
    n = len(data)
    nearest = np.append(np.minimum.accumulate(np.where(back > 0, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1], np.int32(n))
    follow, used, now = memoryview(nearest[np.arange(n, dtype=np.int32) + length]), [], int(nearest[0])
    while now < n:
        used.append(now)
        now = follow[now]
    used = np.array(used, np.int64)
    inside = np.zeros(n + 1, np.int8)
    inside[used + 1] += 1
    inside[used + length[used]] -= 1
    chain = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
    owner, copy = image[chain], np.flatnonzero(back[chain])
    symbol = data[chain].astype(np.int64)
    far = back[chain[copy]]
    wide = np.array(widths)[owner[copy]]
    size_symbol, size_more, size_bits = prefixed(length[chain[copy]])
    far_symbol, far_more, far_bits = prefixed(np.where(far == wide, 1, np.where(far == 1, 2, far + 120)))
    plain = np.ones(len(chain), bool)
    plain[copy] = False
    alphabet = CODES[0]
    if cache:
        alphabet += 1 << CACHE_BITS
        grey = np.arange(256, dtype=np.uint32)
        slot = (((np.uint32(0xFF000000) | grey << np.uint32(16) | grey << np.uint32(8) | grey) * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
        # The pixel before in the same slot of the same image: a hit if it is of the same colour.
        order = np.argsort(image << CACHE_BITS | slot.astype(np.int32)[data], kind="stable")
        hit = np.zeros(len(data), bool)
        x, y = order[1:], order[:-1]
        hit[x] = (image[x] == image[y]) & (data[x] == data[y])
        found = plain & hit[chain]
        symbol[found] = 280 + slot[data[chain[found]]]
    symbol[copy] = 256 + size_symbol
    n = len(streams)
    counts = [np.bincount(owner * alphabet + symbol, minlength=n * alphabet).reshape(n, -1), np.bincount(owner[copy] * 40 + far_symbol, minlength=n * 40).reshape(n, -1)]
    literal = np.flatnonzero(symbol < 256)
    if cache:
        counts.insert(1, np.bincount(owner[literal] * 256 + symbol[literal], minlength=n * 256).reshape(n, -1))
    lengths = [code_lengths(c) for c in counts]
    words = [code_words(x) for x in lengths]
    fields = [code_fields(x, c) for x, c in zip(lengths, counts, strict=True)]
    constant = lambda v: (np.full((n, 1), v[0], np.uint64), np.full((n, 1), v[1]))
    parts = [fields[0], fields[1], fields[1], constant(simple(255)), fields[2]] if cache else [fields[0], constant(rest), fields[1]]
    parts.insert(0, constant((1 | CACHE_BITS << 1, 6) if cache else (0, 2)))
    head, head_bits = (np.concatenate(x, 1) for x in zip(*parts, strict=True))
    # All bits of each symbol in one number: its code, then the extra bits and distance of a copy or the other channels of a literal.
    both = words[0] << np.uint64(8) | lengths[0].astype(np.uint64)
    value = both.ravel()[owner * alphabet + symbol]
    size = (value & np.uint64(0xFF)).astype(np.int64)
    value >>= np.uint64(8)
    code, code_bits = words[-1][owner[copy], far_symbol], lengths[-1][owner[copy], far_symbol]
    used = size[copy]
    for part, part_bits in ((size_more.astype(np.uint64), size_bits), (code, code_bits), (far_more.astype(np.uint64), far_bits)):
        value[copy] |= part << used.astype(np.uint64)
        used = used + part_bits
    size[copy] = used
    if cache:
        code, code_bits = words[1][owner[literal], symbol[literal]], lengths[1][owner[literal], symbol[literal]]
        for _ in range(2):  # red and blue
            value[literal] |= code << size[literal].astype(np.uint64)
            size[literal] += code_bits
    before = np.array([x for _, x in prefixes])
    body = np.bincount(owner, size, n).astype(np.int64)
    bits = before + head_bits.sum(1) + body
    room = (bits + 63) // 64 * 64
    base = np.cumsum(room) - room
    out = np.zeros(int(room.sum()) // 64 + 1, np.uint64)
    at = base + before
    pack(out, head.ravel(), head_bits.ravel(), (at[:, None] + np.cumsum(head_bits, 1) - head_bits).ravel())
    at = at + head_bits.sum(1)
    pack(out, value, size, np.cumsum(size) - size + (at - (np.cumsum(body) - body))[owner])
    raw, files = out.view(np.uint8), []
    for i, (value, _) in enumerate(prefixes):
        whole = raw[base[i] // 8 : base[i] // 8 + (int(bits[i]) + 7) // 8]
        first = np.frombuffer(value.to_bytes((int(before[i]) + 7) // 8, "little"), np.uint8)
        whole[: len(first)] |= first
        files.append(whole.tobytes())
    return files


def uniform(argb: int) -> list[tuple[int, int]]:
    """Fields of an inner image whose pixels are all the same."""
    a, r, g, b = lanes(argb)
    return [(0, 1), simple(g), simple(r), simple(b), simple(a), simple(0)]


def best_predictor(grey: np.ndarray) -> tuple[int, np.ndarray]:
    """(mode, residuals) of the predictor of ``BY_ROWS`` that leaves least; for a grey image."""
    rest = np.empty_like(grey)
    rest[0] = np.diff(grey[0], prepend=np.uint8(0))
    rest[1:, 0] = grey[1:, 0] - grey[:-1, 0]
    left, above, corner = grey[1:, :-1], grey[:-1, 1:], grey[:-1, :-1]
    right = np.concatenate((grey[:-1, 2:], grey[1:, :1]), 1)
    best = None
    for mode, p in ((1, left), (2, above), (3, right), (4, corner), (8, halved(corner, above)), (9, halved(above, right))):
        r = grey[1:, 1:] - p
        cost = int(np.minimum(r, -r).sum(dtype=np.int64))  # r and 256 - r are as far from 0
        if best is None or cost < best[0]:
            best = cost, mode, r
    rest[1:, 1:] = best[2]
    return best[1], rest


def write_grey(images: list[np.ndarray], kind: int) -> list[bytes]:
    """Lossless files of grey images [h, ROW], with the features of a kind."""
    streams, prefixes, widths = [], [], []
    for grey in images:
        out = header(ROW, len(grey))
        stream, width = grey.ravel(), ROW
        if kind == PALETTED:
            used = np.bincount(stream, minlength=256) > 0
            colours = np.flatnonzero(used)
            out.fields([(1, 1), (GREEN, 2), (1, 1), (PALETTE, 2), (len(colours) - 1, 8)])
            # Colours are (255, 0, v, 0) after subtract-green, written as differences: green in flat codes of eight bits.
            out.fields([(0, 1), (0, 1), (8, 4), *((1 if s in (8, 18) else 0, 3) for s in CODE_ORDER[:12]), (0, 1), (0, 256), (1, 1), (CODES[0] - 256 - 11, 7)])
            out.fields([simple(0), simple(0), simple(0, 255), simple(0)])
            for i, d in enumerate(np.diff(colours, prepend=0).tolist()):
                out.fields([(int(REVERSED[d]) >> 7, 8), (i == 0, 1)])
            bits = bundle_bits(len(colours))
            stream, width = (np.cumsum(used) - 1).astype(np.uint8)[stream], tiles(ROW, bits)
            if bits:
                per = 1 << bits
                stream = np.bitwise_or.reduce(stream.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * np.uint8(8 >> bits)), axis=1).astype(np.uint8)
        elif kind == CROSSED:  # red and blue lose 32 times green, shifted by five
            out.fields([(1, 1), (CROSS, 2), (7, 3), *uniform(joined(255, 0, 32, 32))])
        elif kind == PREDICTED:
            mode, rest = best_predictor(grey)
            out.fields([(1, 1), (PREDICTOR, 2), (7, 3), *uniform(joined(255, 0, mode, 0)), (1, 1), (GREEN, 2)])
            stream = rest.ravel()
        out.write(0, 1)
        streams.append(stream)
        prefixes.append((out.value, out.n))
        widths.append(width)
    others = Writer()
    others.fields([simple(0), simple(0), simple(0 if kind == PREDICTED else 255)])
    return [riff(x) for x in entropy_coded(streams, prefixes, widths, (others.value, others.n), kind == CACHED)]


# ---------------------------------------------------------------- payloads


def store(payloads: list[bytes]) -> list[bytes]:
    """Payloads, each a positive multiple of 64 bytes, as grey samples of one or more images in a row."""
    out: list[list[bytes]] = [[] for _ in payloads]
    waiting: list[list[tuple[int, np.ndarray]]] = [[] for _ in KINDS]

    def write(kind: int) -> None:
        for (i, _), x in zip(waiting[kind], write_grey([g for _, g in waiting[kind]], kind), strict=True):
            out[i].append(x)
        waiting[kind].clear()

    for i, payload in enumerate(payloads):
        grey, kind = np.frombuffer(payload, np.uint8).reshape(-1, ROW), zlib.crc32(payload) % len(KINDS)
        for at in range(0, len(grey), ROWS):
            waiting[kind].append((i, grey[at : at + ROWS]))
            if sum(g.size for _, g in waiting[kind]) >= TOGETHER:
                write(kind)
    for kind in KINDS:
        if waiting[kind]:
            write(kind)
    return [b"".join(x) for x in out]


def samples(media: bytes) -> list[np.ndarray]:
    """The grey samples [h, ROW] of images in a row; ValueError if one is not grey."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        data = media[at : at + size]
        pixels = decode_pixels(data)
        grey = (pixels.colours >> np.uint32(8)).astype(np.uint8)
        other = grey * np.uint32(0x010101) + np.uint32(0xFF000000) != pixels.colours
        if other.any() and (pixels.index is None or other[pixels.index].any()):  # (a colour may be one that no pixel has)
            raise ValueError("the image is not grey")
        out.append((grey if pixels.index is None else grey[pixels.index]).reshape(shape_of(data)))
        at += size
    return out


def feature(parts: list[np.ndarray]) -> str:
    """Width, height, image count, mean luminance in thousandths, and an 8 by 8 average hash of the luminance by rows."""
    h = sum(len(p) for p in parts)
    rows = np.concatenate([p.sum(1, dtype=np.int64) for p in parts])
    cells = np.add.reduceat(rows, np.arange(64) * h // 64) if h >= 64 else np.resize(rows, 64)
    sizes = np.diff(np.append(np.arange(64) * h // 64, h)) if h >= 64 else np.ones(64, np.int64)
    mean = cells // sizes
    code = int.from_bytes(np.packbits(mean > mean.mean()).tobytes(), "big")
    return f"{ROW}x{h}/{len(parts)};{int(rows.sum()) * 1000 // (h * ROW)};{code:016x}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as padded UTF-8 in lossless WebP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            raw = [memoryview(t.as_buffer()) if t.is_valid else memoryview(b"") for t in batch.column(1)]
            media = store([bytes(r) + b"\0" * (64 if not len(r) else -len(r) % 64) for r in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Decode stored media; one row of digests and features for each."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            rows = []
            for stored in batch.column(2):
                raw = stored.as_py()
                parts = samples(raw)
                data = b"".join(p.tobytes() for p in parts)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(parts)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return media.mapInArrow(common.tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_webp(spark, sf_dir: str) -> DataFrame:
    """Store every text as lossless WebP, read it back and describe it.

    Null and empty texts are 64 zero bytes; equal texts give equal values; very long texts take several images in a
    row, so that memory does not grow with them but for the text itself; repeated rows are kept; ids may be null;
    further columns are ignored; an empty table gives an empty result.  The stored media are a Parquet table in the
    shared folder."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return describe(common.materialize(to_media(docs), "webp", "zstd"))
