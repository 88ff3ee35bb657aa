"""Windows of subword tokens with their places in the text, for ``chunking.chunks``.

The vocabulary file's path is a parameter (the file must be on every executor); the library's offsets are characters of
the text, so characters of several bytes and tokens of parts of them need no map of their own.  Texts longer than ``PIECE`` go
through the library in pieces, cut before single spaces, where no token can cross."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: Characters encoded at once, unless there is no place to cut.
PIECE = 1 << 16
CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def library(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def pieces(doc: str, size: int) -> Iterator[tuple[int, str]]:
    """(place, piece) of a text, cut before the first single space after ``size`` characters."""
    at = 0
    while len(doc) - at > size:
        cut = CUT.search(doc, at + size)
        if cut is None:
            break
        yield at, doc[at : cut.start()]
        at = cut.start()
    yield at, doc[at:]


def offsets(path: str, doc: str, size: int = PIECE) -> list[tuple[int, int]]:
    """(start, end) of every token."""
    out = []
    for at, piece in pieces(doc, size):
        out += [(at + a, at + b) for a, b in library(path).encode(piece, add_special_tokens=False).offsets]
    return out


def windows(path: str):
    """A tokenizer for ``chunking.chunks``: (start, end, tokens) of windows of ``size`` tokens, ``overlap`` of them shared."""

    def spans(doc: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
        found, out = offsets(path, doc), []
        for at in range(0, len(found), size - overlap):
            part = found[at : at + size]
            out.append((min(a for a, _ in part), max(b for _, b in part), len(part)))
            if at + size >= len(found):
                break
        return out

    return spans
