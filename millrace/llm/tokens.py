"""Vectorised words of Arrow strings: 64-bit hashes of words and of runs of words, without Python objects.

A word is a longest run, after lower-casing, of ASCII letters and digits and of characters beyond ASCII,
where U+0080 to U+00BF (but for ª, µ, º), general punctuation (U+2000 to U+207F) and CJK punctuation
(U+3000 to U+303F) divide words as ASCII punctuation does.

A word's hash sums pseudo-random numbers of its bytes and their places.  (A polynomial modulo 2^64 would give
some different words, such as a Thue-Morse word and its complement, the same hash whatever its base.)  Where two texts
must be the same ones, their bytes are compared or go through a cryptographic digest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Bytes of text hashed at once, but for single longer texts.
PIECE = 1 << 19
#: Places in a word whose numbers are looked up; further ones are computed.
PLACES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _number(index: np.ndarray) -> np.ndarray:
    return mixed(index.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


NUMBERS = _number(np.arange(256 * PLACES))


def sums(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums [n + 1] of the numbers of bytes at their places, which count from the last of ``starts``."""
    n = len(data)
    kind = np.int32 if n < 1 << 23 else np.int64
    begin = np.zeros(n, kind)
    begin[starts] = starts
    index = np.arange(n, dtype=kind)
    index -= np.maximum.accumulate(begin, out=begin)
    index <<= 8
    index |= data
    numbers = np.take(NUMBERS, index, mode="clip")
    far = np.flatnonzero(index >= len(NUMBERS))
    if len(far):
        numbers[far] = _number(index[far])
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(numbers, out=out[1:])
    return out


@dataclass
class Words:
    """hashes of all words; words of text i are at first[i] to first[i + 1]; starts and ends are bytes in ``data``; bounds
    are where texts begin there; total has the running sums."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    total: np.ndarray

    @cached_property
    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all words in a row, length of each word, where each word begins there and the last ends)."""
        n = (self.ends - self.starts).astype(np.uint32)
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        return self.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)], n, at

    def content(self, i: int) -> bytes:
        """The words of text i as bytes; other words give other bytes."""
        flat, n, at = self.packed
        a, b = self.first[i], self.first[i + 1]
        return flat[at[a] : at[b]].tobytes() + n[a:b].tobytes()


def _piece(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), empty, empty, data, offsets, np.zeros(1, np.uint64))
    word = WORD[data]
    high = np.flatnonzero(data >= 0xC2)
    lead = data[high]
    for byte, seconds, length in ((0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3), (0xC2, None, 2)):
        at = high[lead == byte]
        if len(at):
            second = data[np.minimum(at + 1, n - 1)]
            at = at[np.isin(second, seconds)] if seconds else at[~np.isin(second, (0xAA, 0xB5, 0xBA))]
            for k in range(length):
                word[at + k] = False
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    total = sums(data, starts)
    return Words(mixed(total[ends] - total[starts]), np.searchsorted(starts, offsets), starts, ends, data, offsets, total)


def pieces(texts: pa.Array):
    """(index of the first text, Words) for consecutive groups of lower-cased texts of at most PIECE bytes."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, _piece(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and where each text's runs begin; a shorter text is one run, an empty one none."""
    counts = np.diff(words.first)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(runs)))
    start = np.repeat(words.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    left = np.repeat(words.first[1:], runs) - start
    h = np.full(first[-1], 0x243F6A8885A308D3, np.uint64)
    padded = np.concatenate((words.hashes, np.zeros(n, np.uint64)))
    for k in range(n):
        h = h * np.uint64(0x100000001B3 * 2 + 1) + np.where(left > k, padded[start + k], np.uint64(k + 1))
    return mixed(h), first
