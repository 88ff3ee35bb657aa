"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is lower-cased and read as bytes, all of them, white space included.  Two gated recurrent layers read it in either
direction, in overlapping windows; at every byte position a softmax over both states labels the language.  A document's
probabilities are the means over all its positions.  The network is trained by backpropagation through time on
a bounded, hashed sample of labelled documents (about ``SAMPLE`` of each language, all of their text).

Positions are computed in windows of about ``WIDE``: both states start anew ``CONTEXT`` bytes before (after) each window, or where
the text begins (ends), so a label sees at least so many bytes on either side, words before and after included, but
nothing of what is farther away.  A text's length changes neither what is read nor the memory that it takes.

Defined cases: null texts and texts without a letter are ``und`` with score 0; documents whose language is
null are not learned from; of languages with equal probabilities the first in alphabetical order is taken; very long
texts are read whole; repeated rows give repeated results; null ids count as an empty text for the fold; where
nothing can be learned every document is ``und``; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

HIDDEN, WIDE, CONTEXT, SAMPLE = 12, 224, 16, 400
STEPS, BATCH, TRAINED, RATE, SEED = 400, 192, 48, 0.01, 7
UNKNOWN = "und"
#: Bytes whose windows are computed at once: few enough rows for products in one thread.
PIECE = 1 << 17


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters: for each direction the byte table x [256, 3H] with biases, u [H, 3H]; v [2H, K], c [K]."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k, self.languages = len(languages), languages
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {f"{n}{d}": draw(*s, scale=c) for d in "fb" for n, s, c in (("x", (256, 3 * hidden), 0.3), ("u", (hidden, 3 * hidden), hidden**-0.5))}
        self.p |= {"v": draw(2 * hidden, k, scale=hidden**-0.5), "c": np.zeros(k, np.float32)}

    def run(self, data: np.ndarray, lengths: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States [T, B, H] of one direction over rows of bytes; past its end a row keeps its state."""
        x, u = self.p["x" + d], self.p["u" + d]
        n, steps = data.shape
        hid = u.shape[0]
        h, out = np.zeros((n, hid), np.float32), np.zeros((steps, n, hid), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = x[data[:, t]], h @ u
            zr = sigmoid(a[:, : 2 * hid] + g[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            m = np.tanh(a[:, 2 * hid :] + r * g[:, 2 * hid :])
            live = (t < lengths)[:, None]
            new = np.where(live, m + z * (h - m), h)
            if keep is not None:
                keep.append((t, h, z, r, m, g[:, 2 * hid :], live))
            h = out[t] = new
        return out

    def probabilities(self, data: np.ndarray, lengths: np.ndarray, kept: dict | None = None):
        """Label probabilities [T, B, K] of every position."""
        states = [self.run(data, lengths, d, None if kept is None else kept.setdefault(d, [])) for d in "fb"]
        s = np.concatenate(states, -1) @ self.p["v"] + self.p["c"]
        e = np.exp(s - s.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True), states

    def gradients(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss over positions, and its gradients by backpropagation through time."""
        kept: dict = {}
        p, states = self.probabilities(data, lengths, kept)
        steps, n, _ = p.shape
        live = (np.arange(steps)[:, None] < lengths)[:, :, None]
        total = lengths.sum()
        right = p[:, np.arange(n), labels]
        loss = float(-(np.log(right + 1e-9) * live[:, :, 0]).sum() / total)
        d = p.copy()
        d[:, np.arange(n), labels] -= 1
        d *= live / np.float32(total)
        both = np.concatenate(states, -1)
        g = {"v": np.einsum("tbh,tbk->hk", both, d, optimize=True), "c": d.sum((0, 1))}
        back = d @ self.p["v"].T
        hid = states[0].shape[-1]
        for i, side in enumerate("fb"):
            u = self.p["u" + side]
            gu, found, at = np.zeros_like(u), [], []
            dh = np.zeros((n, hid), np.float32)
            for t, h, z, r, m, gm, alive in reversed(kept[side]):
                dh = dh + back[t][:, i * hid : (i + 1) * hid]
                da = np.where(alive, dh, 0)
                dm = da * (1 - z) * (1 - m * m)
                dz = da * (h - m) * z * (1 - z)
                dr = dm * gm * r * (1 - r)
                dg = np.concatenate((dz, dr, dm * r), 1)
                found.append(np.concatenate((dz, dr, dm), 1))
                at.append(data[:, t])
                gu += h.T @ dg
                dh = np.where(alive, da * z, dh) + dg @ u.T
            at = np.concatenate(at)
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order], prepend=-1))
            gx = np.zeros_like(self.p["x" + side])
            gx[at[order][edges]] = np.add.reduceat(np.concatenate(found)[order], edges)
            g["x" + side], g["u" + side] = gx, gu
        return loss, g

    def logits(self, data: np.ndarray, lengths: np.ndarray, d: str) -> np.ndarray:
        """What one direction adds to the label scores, [T, K, B], in reading order; ``lengths`` descend.

        The same as ``run`` with its output layer, for reading only: rows that have ended are left out."""
        hid = self.p["u" + d].shape[0]
        half = np.concatenate((np.full(2 * hid, 0.5), np.ones(hid))).astype(np.float32)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        x, u = self.p["x" + d] * half, np.ascontiguousarray((self.p["u" + d] * half).T)
        v = np.ascontiguousarray((self.p["v"][:hid] if d == "f" else self.p["v"][hid:]).T)
        steps, data = int(lengths[0]), np.ascontiguousarray(data.T)
        rows = data.shape[1]
        out, h, taken = np.zeros((steps, len(v), rows), np.float32), np.zeros((hid, rows), np.float32), np.zeros((rows, 3 * hid), np.float32)
        live = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()
        for t, n in enumerate(live):  # features by rows, so that gates are whole stretches of memory
            if n < h.shape[1]:
                h, taken = np.ascontiguousarray(h[:, :n]), taken[:n]
            np.take(x, data[t, :n], axis=0, out=taken, mode="clip")
            a, g = np.ascontiguousarray(taken.T), u @ h
            gates, m = a[: 2 * hid], a[2 * hid :]
            gates += g[: 2 * hid]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            m += np.multiply(gates[hid:], g[2 * hid :], out=g[2 * hid :])
            np.tanh(m, out=m)
            h -= m
            h *= gates[:hid]
            h += m
            out[t, :, :n] = v @ h
        return out

    def train(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> float:
        """Adam over batches in which languages are equally frequent."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        by = [np.flatnonzero(labels == i) for i in range(k)]
        first = {n: np.zeros_like(v) for n, v in self.p.items()}
        second = {n: np.zeros_like(v) for n, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(x, max(1, BATCH // k)) for x in by])
            wide = int(lengths[rows].max())
            loss, g = self.gradients(data[rows, :wide], lengths[rows], labels[rows])
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for n, v in g.items():
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.99 * second[n] + 0.01 * v * v
                self.p[n] -= (rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


@dataclass
class Windows:
    """Windows of texts: bytes from ``low`` to ``high`` are read, those from ``start`` to ``end`` labelled."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def rows(self, order: np.ndarray, reverse: bool = False) -> np.ndarray:
        """The read bytes of windows, padded with 0."""
        low, n = self.low[order], self.high[order] - self.low[order]
        at = np.arange(int(n.max()))
        place = (low + n)[:, None] - 1 - at if reverse else low[:, None] + at
        return np.where(at < n[:, None], self.data[np.clip(place, 0, len(self.data) - 1)], 0)


def windows(texts: pa.Array, wide: int = WIDE, context: int = CONTEXT) -> Iterator[Windows]:
    """The windows of all texts in groups of about ``PIECE`` bytes; ``text`` counts from the first text of all."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    every = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] is not None else np.zeros(0, np.uint8)
    n = np.diff(offsets)
    count = -(-n // wide)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start, end = offsets[text] + k * n[text] // count[text], offsets[text] + (k + 1) * n[text] // count[text]
    first, last = np.maximum(start - context, offsets[text]), np.minimum(end + context, offsets[text + 1])
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        a, b = first[at], last[to - 1]
        yield Windows(every[a:b], text[at:to], *(x[at:to] - a for x in (start, end, first, last)))
        at = to


def documents(texts: pa.Array, network: Network) -> np.ndarray:
    """Mean label probabilities of each text over all its positions; zeros where it has none."""
    k = len(network.languages)
    sums, positions = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    for w in windows(texts):
        size = w.high - w.low
        order = np.argsort(-size, kind="stable")
        size, steps = size[order], int(size.max())
        scores = network.logits(w.rows(order), size, "f")
        back = network.logits(w.rows(order, True), size, "b")
        start, end = w.start[order] - w.low[order], w.end[order] - w.low[order]
        t = np.arange(steps)[:, None]
        scores += np.take_along_axis(back, np.maximum(size - 1 - t, 0)[:, None], 0)
        scores += network.p["c"][:, None]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        scores *= ((t >= start) & (t < end))[:, None]
        found = scores.sum(0, dtype=np.float64)
        for j in range(k):
            sums[:, j] += np.bincount(w.text[order], found[j], len(texts))
        positions += np.bincount(w.text[order], end - start, len(texts)).astype(np.int64)
    return sums / np.maximum(1, positions)[:, None]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on about ``sample`` labelled documents of each language outside the held-out fold, in windows of ``TRAINED`` bytes."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    chosen = rows.where(F.abs(F.xxhash64("doc_id", "text") % 1_000_003) < share[F.col("lang")] * 1_000_003).select("lang", "text").toArrow()
    order = pc.sort_indices(chosen, [("lang", "ascending"), ("text", "ascending")])
    chosen = chosen.take(order).combine_chunks()
    languages = sorted(set(chosen["lang"].to_pylist()))
    texts, labels = chosen["text"].combine_chunks(), np.array([languages.index(x) for x in chosen["lang"].to_pylist()])
    data, lengths, label = [], [], []
    for w in windows(texts, TRAINED, 0):
        part = w.rows(np.arange(len(w.text)))
        wide = np.zeros((len(part), TRAINED), np.uint8)
        wide[:, : part.shape[1]] = part
        data.append(wide)
        lengths.append(w.end - w.start)
        label.append(labels[w.text])
    if not data:
        return None
    data, lengths, label = (np.concatenate(x) for x in (data, lengths, label))
    present = np.unique(label)
    network = Network([languages[i] for i in present])
    network.train(data, lengths, np.searchsorted(present, label))
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            texts = batch.column(2)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if network is None:
                labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p = documents(texts, network)
                labels = np.where(letters, np.array(network.languages, object)[p.argmax(1)], UNKNOWN).tolist()
                score = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(common.tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
