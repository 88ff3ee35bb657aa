"""Pluggable embedders: prompts, batches, and a deterministic hashing model for tests and offline use."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

QUERY_PROMPT, DOCUMENT_PROMPT = "task: search result | query: ", "title: none | text: "
WINDOW, HIDDEN = 512, 768


def hashing(texts: list[str], dims: int = HIDDEN) -> np.ndarray:
    """Unit vectors of signed word counts; equal texts give equal vectors."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dims] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def packed(lengths: list[int], limit: int, window: int = WINDOW) -> list[list[int]]:
    """Neighbouring inputs in batches: longest times count within ``limit``, lengths within a window of each other."""
    out: list[list[int]] = []
    low = high = 0
    for i, n in enumerate(lengths):
        if n > limit:
            raise ValueError(f"input {i} has {n} tokens; a batch holds {limit}")
        if out and max(high, n) * (len(out[-1]) + 1) <= limit and max(high, n) - min(low, n) <= window - 1:
            out[-1].append(i)
            low, high = min(low, n), max(high, n)
        else:
            out.append([i])
            low = high = n
    return out


def embed(df: DataFrame, key: str, column: str, prompt: str = DOCUMENT_PROMPT, model: Callable[[list[str]], np.ndarray] = hashing, dims: int = HIDDEN, limit: int = 8 * WINDOW) -> DataFrame:
    """(key, embedding): vectors of the prompted texts, cut to ``dims`` and of length 1; in Arrow batches."""
    if not 1 <= dims <= HIDDEN:
        raise ValueError(f"dims must be between 1 and {HIDDEN}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [prompt + (t or "") for t in batch.column(1).to_pylist()]
            vectors: list[np.ndarray] = []
            for group in packed([min(len(t.split()), limit) for t in texts], limit):
                v = model([texts[i] for i in group])[:, :dims]
                n = np.linalg.norm(v, axis=1, keepdims=True)
                vectors += list(v / np.where(n > 0, n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
