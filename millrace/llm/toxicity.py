"""Toxic spans by a linear-chain conditional random field over words.

Words (see ``tokens``) carry features: their hash and the hashes of their first 4, 5 and 6 bytes.  Document
labels give token labels first: features that occur in toxic documents far more often than in others mark
the tokens of toxic documents.  On those labelled tokens a two-state chain is trained by gradient ascent on
its conditional likelihood; forward-backward marginals tag every word of every text.  A logistic curve over
the expected number of toxic words, their density and the largest marginal gives the document's score, and
runs of words with a marginal of 0.5 or more are the offending spans (offsets in characters of the
lower-cased text).

Recursions run over fixed-length columns of the concatenated words of a batch: 2 by 2 products carry the
state over column borders, so very long texts cost no more than short ones.

Training uses at most about ``SAMPLE`` hashed documents of each label outside the held-out fold, whole, for the labelled
tokens, the chain and the curve alike; scoring covers every document whole.  Defined cases: null, empty and wordless texts have no spans and the score of
no evidence; a document with several labels counts as toxic if one says so; null labels are no labels;
repeated rows give repeated results; a score of exactly ``THRESHOLD`` counts as toxic; without labels of both kinds
every score is 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common, tokens

SAMPLE, THRESHOLD = 2000, 0.3
PREFIXES = (4, 5, 6)
#: A feature marks tokens if so many toxic documents, and this share of them, have it and its odds are at least so high.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 4, 0.005, 20.0
STEPS, RATE, PENALTY, COLUMN = 90, 0.3, 1e-4, 128
#: Words of a step of the chain's training; the steps go through all sampled documents in turn.
STEP_WORDS = 250_000


def features(words: tokens.Words) -> list[np.ndarray]:
    """Hashes of each feature of each word; 0 where a word has none."""
    out = [words.hashes]
    for k in PREFIXES:
        at = np.minimum(words.starts + k, words.ends)
        h = tokens.mixed(words.total[at] - words.total[words.starts] + np.uint64(k))
        out.append(np.where(words.ends - words.starts > k, h, np.uint64(0)))
    return out


@dataclass
class Chain:
    """Weights of features for the toxic state, transitions [from, to] and the start of the toxic state, in log odds."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    start: float
    curve: np.ndarray

    def __post_init__(self):
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def index(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys, else their number."""
        out = np.full(len(h), len(self.keys), np.int32)
        maybe = np.flatnonzero(self.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == h[maybe], at, len(self.keys))
        return out

    def scores(self, index: list[np.ndarray]) -> np.ndarray:
        w = np.append(self.weights, 0.0)
        return np.clip(self.bias + sum(w[i] for i in index), -20, 20)


def columns(x: np.ndarray, fill) -> np.ndarray:
    """The stream as columns [COLUMN, n]."""
    n = -(-len(x) // COLUMN)
    out = np.full(n * COLUMN, fill, x.dtype)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(n, COLUMN).T)


def chained(e: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, first: float) -> np.ndarray:
    """x[t] = e[t] (b[t] + x[t-1] d[t]) / (a[t] + x[t-1] c[t]) along the stream of columns, from ``first``."""
    n = e.shape[1]
    p, q, r, s = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)  # column product: x -> (q + x s) / (p + x r)
    for t in range(COLUMN):
        eb, ed = e[t] * b[t], e[t] * d[t]
        p, q = p * a[t] + q * c[t], p * eb + q * ed
        r, s = r * a[t] + s * c[t], r * eb + s * ed
        scale = p + q
        p, q, r, s = p / scale, q / scale, r / scale, s / scale
    x = np.empty(n)
    now = first
    for k, (i, j, m, o) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        x[k] = now
        now = (j + now * o) / (i + now * m)
    out = np.empty_like(e)
    for t in range(COLUMN):
        x = out[t] = e[t] * (b[t] + x * d[t]) / (a[t] + x * c[t])
    return out


def marginals(score: np.ndarray, begins: np.ndarray, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the toxic state at each word, of both it and its predecessor [4, n]); ``begins`` marks first words."""
    n = len(score)
    t = np.exp(move)
    e = columns(np.exp(score), 1.0)
    new = columns(begins, True)
    one = np.ones_like(e)
    pick = lambda v, w: np.where(new, w, v)
    fore = chained(e, pick(t[0, 0], one), pick(t[0, 1], np.exp(start)), pick(t[1, 0], 0.0), pick(t[1, 1], 0.0), 0.0).T.ravel()[:n]
    # Backwards: y[t] = (t10 + t11 e[t+1] y[t+1]) / (t00 + t01 e[t+1] y[t+1]), 1 before a new text.
    ahead = np.append(np.exp(score[1:]), 1.0)[::-1]
    last = np.append(begins[1:], True)[::-1]
    e2, new = columns(ahead, 1.0), columns(last, True)
    back = chained(one, pick(t[0, 0], one), pick(t[1, 0], one), pick(t[0, 1] * e2, 0.0), pick(t[1, 1] * e2, 0.0), 1.0).T.ravel()[:n][::-1]
    odds = fore * back
    p = odds / (1 + odds)
    pairs = np.zeros((4, n))
    if n > 1:
        x, y, ex = fore[:-1], back[1:], np.exp(score[1:])
        raw = np.stack([t[0, 0] * np.ones(n - 1), t[0, 1] * ex * y, x * t[1, 0], x * t[1, 1] * ex * y])
        pairs[:, 1:] = np.where(begins[1:], 0, raw / raw.sum(0))
    return p, pairs


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: log of the expected number of toxic words, of their density, the largest marginal; [n, 3]."""
    n = np.diff(first)
    total = np.diff(np.concatenate(([0.0], np.cumsum(p)))[first])
    most = np.zeros(len(n))
    full = n > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.stack([np.log1p(np.maximum(total, 0)), np.log1p(100 * np.maximum(total, 0) / np.maximum(n, 1)), most], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is last."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b = b + np.linalg.solve(h, g)
    return b


def unlike(texts: pa.Array, hashes: int = 8) -> np.ndarray:
    """First of each group of texts that share a least hash of five words under one of ``hashes`` hash functions.

    The words of a text with many near copies would else seem to be typical of its label."""
    low = [np.zeros((0, hashes), np.uint64)]
    for at, w in tokens.pieces(texts):
        h, first = tokens.windows(w, 5)
        full = np.flatnonzero(np.diff(first) > 0)
        part = np.zeros((len(first) - 1, hashes), np.uint64)
        part[:] = tokens.mixed(np.arange(at, at + len(part)).astype(np.uint64) + np.uint64(1 << 60))[:, None]
        for k in range(hashes):
            if len(full):
                part[full, k] = np.minimum.reduceat(tokens.mixed(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), first[:-1][full])
        low.append(part)
    low = np.concatenate(low)
    group = np.arange(len(low))
    while True:
        before = group.copy()
        for k in range(hashes):
            _, inverse = np.unique(low[:, k], return_inverse=True)
            least = np.full(inverse.max(initial=0) + 1, len(low))
            np.minimum.at(least, inverse, group)
            group = least[inverse]
        if (group == before).all():
            return np.unique(group)


def train(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray) -> Chain:
    """Label tokens, fit the chain on them and the curve on the documents; copies count once."""
    once = unlike(texts)
    texts, toxic, weight = texts.take(pa.array(once)), toxic[once], weight[once]
    parts = [(at, w, features(w)) for at, w in tokens.pieces(texts)]
    # Documents of either label that have a feature, counted once each.
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for at, w, fs in parts:
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        mark = tokens.mixed((doc + 1).astype(np.uint64))
        for f in fs:
            one = np.unique(f ^ mark, return_index=True)[1]
            one = one[f[one] > 0]
            hashes.append(f[one])
            docs.append((doc[one] + at).astype(np.int32))
    hashes, docs = np.concatenate(hashes), np.concatenate(docs)
    keys, inverse = np.unique(hashes, return_inverse=True)
    has = toxic[docs]
    bad = np.bincount(inverse, has, len(keys))
    good = np.bincount(inverse, ~has, len(keys))
    odds = (bad + 0.5) / (toxic.sum() + 1) / ((good + 0.5) / ((~toxic).sum() + 1))
    marks = keys[(bad >= max(LEAST_DOCS, LEAST_SHARE * toxic.sum())) & (odds >= LEAST_ODDS)]
    kept = (bad >= LEAST_DOCS) & ((odds >= 2) | (good >= 50))
    chain = Chain(keys[kept], np.zeros(kept.sum()), -4.0, np.zeros((2, 2)), 0.0, np.zeros(4))
    if not len(chain.keys):
        chain.keys, chain.weights = np.array([1], np.uint64), np.zeros(1)
    marked = Chain(marks if len(marks) else np.array([1], np.uint64), np.zeros(max(1, len(marks))), 0.0, chain.move, 0.0, chain.curve)
    batches: list[tuple] = []
    index, labels, begins = [[] for _ in range(1 + len(PREFIXES))], [], []
    for k, (at, w, fs) in enumerate(parts):
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first)) + at
        hit = np.zeros(len(doc), bool)
        for f in fs:
            hit |= marked.index(f) < len(marked.keys)
        for i, f in enumerate(fs):
            index[i].append(chain.index(f))
        labels.append(hit & toxic[doc])
        begins.append(begin_marks(w))
        if sum(map(len, labels)) >= STEP_WORDS or k == len(parts) - 1:
            batches.append(([np.concatenate(i) for i in index], np.concatenate(labels), np.concatenate(begins)))
            index, labels, begins = [[] for _ in range(1 + len(PREFIXES))], [], []
    batches = [b for b in batches if len(b[1])]
    if batches:
        climb(chain, batches)
    rows = [document_features(marginals(chain.scores([chain.index(f) for f in fs]), begin_marks(w), chain.move, chain.start)[0] if len(w.hashes) else np.zeros(0), w.first) for _, w, fs in parts]
    chain.curve = logistic(np.concatenate(rows), toxic.astype(float), weight)
    return chain


def begin_marks(w: tokens.Words) -> np.ndarray:
    out = np.zeros(len(w.hashes), bool)
    out[w.first[:-1][np.diff(w.first) > 0]] = True
    return out


def climb(chain: Chain, batches: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> None:
    """Adam on the conditional log-likelihood of token labels, one batch (features, labels, first words) a step."""
    k = len(chain.keys)
    theta = np.concatenate((chain.weights, [chain.bias, 0.0], np.zeros(4)))  # weights, bias, start, moves
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        index, y, begins = batches[step % len(batches)]
        both = 2 * y[:-1].astype(int) + y[1:]
        seen = np.bincount(both[~begins[1:]], minlength=4)
        chain.weights, chain.bias, chain.start, chain.move = theta[:k], theta[k], theta[k + 1], theta[k + 2 :].reshape(2, 2)
        p, pairs = marginals(chain.scores(index), begins, chain.move, chain.start)
        d = y - p
        g = np.zeros_like(theta)
        for i in index:
            g[:k] += np.bincount(i, d, k + 1)[:k]
        g[k], g[k + 1] = d.sum(), d[begins].sum()
        g[k + 2 :] = seen - pairs.sum(1)
        g = g / len(y) - PENALTY * theta * np.append(np.full(k, 1e-2), np.zeros(6))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    chain.weights, chain.bias, chain.start, chain.move = theta[:k], theta[k], theta[k + 1], theta[k + 2 :].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """Train on about ``sample`` documents of each label outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") > 0, min(1.0, sample / counts[True])).otherwise(min(1.0, sample / counts[False]))
    chosen = known.where(F.abs(F.xxhash64("doc_id") % 1_000_003) < share * 1_000_003)
    table = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    if not len(table):
        return None
    order = np.random.default_rng(11).permutation(len(table))
    table = table.take(pa.array(order)).combine_chunks()
    toxic = table["toxic"].to_numpy() > 0
    weight = np.where(toxic, max(1.0, counts[True] / sample), max(1.0, counts[False] / sample))
    return train(table["text"].combine_chunks(), toxic, weight / weight.mean())


def spans(p: np.ndarray, w: tokens.Words, i: int, at: int) -> list[dict]:
    """Runs of toxic words of text i, as character offsets."""
    words = np.flatnonzero(p[w.first[i] : w.first[i + 1]] >= 0.5) + w.first[i]
    if not len(words):
        return []
    runs = np.split(words, np.flatnonzero(np.diff(words) > 1) + 1)
    place = lambda b: int(np.count_nonzero((w.data[at:b] & 0xC0) != 0x80))
    return [{"start": place(w.starts[r[0]]), "end": place(w.ends[r[-1]])} for r in runs]


def tag(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words, spans for every document."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            score, count, found = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            if chain:
                for at, w in tokens.pieces(batch.column(2)):
                    p = marginals(chain.scores([chain.index(f) for f in features(w)]), begin_marks(w), chain.move, chain.start)[0] if len(w.hashes) else np.zeros(0)
                    x = document_features(p, w.first)
                    got = slice(at, at + len(x))
                    score[got] = 1 / (1 + np.exp(-np.clip(x @ chain.curve[:-1] + chain.curve[-1], -30, 30)))
                    hits = np.diff(np.concatenate(([0], np.cumsum(p >= 0.5)))[w.first])
                    count[got] = hits
                    for i in np.flatnonzero(hits):
                        found[at + i] = spans(p, w, i, w.bounds[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(count), pa.array(found, span)],
                ["doc_id", "held_out", "score", "predicted", "toxic_words", "spans"],
            )

    rows = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(common.tidy(run), "doc_id long, held_out boolean, score double, predicted int, toxic_words long, spans array<struct<start: long, end: long>>")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score every whole text for toxicity."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tag(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
