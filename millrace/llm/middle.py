"""Fill-in-the-middle transformation of texts, cut by a byte automaton.

A table of 6 states by 256 bytes says for every byte of a text in UTF-8 which state comes next and what is counted: that
a unit (code point) begins, and that a sentinel ends.  The states are a boundary, "<", "<" and a sentinel's letter, and
one to three bytes of a character to come.  Texts are cut into lanes of ``LANE`` bytes that go through the table side by
side, one byte of every lane a step; lanes that turn out to begin in the middle of a character or a sentinel go through
again from the state in which the lane before them ended, until none is left, so the counts are those of one scan from
left to right.  That scan leaves only counts of each lane.  The second pass finds the lane of each cut by these counts and
goes through that lane alone to the byte where the unit begins.

Where a text is cut is drawn from the SHA-256 of the seed and its id: the cuts depend on nothing else, so reruns and
other partitions give the same rows.

Defined cases: null is the empty text; empty texts and those that hold a sentinel stay plain; a null id is drawn by the
seed alone; repeated rows give repeated results; bytes that are no UTF-8 belong to the unit before them; very long texts
are many lanes, of which ``LANES`` are held in the working arrays at once; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of those the percent in suffix-prefix-middle form.
RATE, SPM, SEED = 90, 20, 1
#: Bytes of a lane, and lanes that go through the table side by side.
LANE, LANES = 256, 1 << 14

BOUNDARY, OPENED, LETTER, ONE, TWO, THREE = range(6)
#: What a transition counts: the beginning of a unit, the end of a sentinel.
UNIT, SENTINEL = 1, 1 << 32


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state times 256, what is counted) by state * 256 + byte."""
    to, counts = np.zeros((6, 256), np.int16), np.zeros((6, 256), np.int64)
    for state in range(6):
        for byte in range(256):
            more = byte & 0xC0 == 0x80
            if more:
                to[state, byte] = {TWO: ONE, THREE: TWO}.get(state, BOUNDARY)
                continue
            counts[state, byte] = UNIT
            to[state, byte] = THREE if byte >= 0xF0 else TWO if byte >= 0xE0 else ONE if byte >= 0xC0 else OPENED if byte == ord("<") else BOUNDARY
            if state == OPENED and chr(byte) in (PREFIX[1], SUFFIX[1], MIDDLE[1]):
                to[state, byte] = LETTER
            elif state == LETTER and byte == ord(">"):
                counts[state, byte] += SENTINEL
    return (to.astype(np.int32) * 256).ravel(), counts.ravel()


NEXT, COUNTS = tables()


def through(data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end states, counts) of lanes that begin at ``start`` in ``state``; states are multiples of 256."""
    ends, counted = np.empty(len(start), np.int32), np.empty(len(start), np.int64)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), LANES):
        mine = order[at : at + LANES]
        long, now, sums = size[mine], state[mine].copy(), np.zeros(len(mine), np.int64)
        open_ = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), "left")  # lanes that have a byte left, by step
        first = start[mine]
        for k, m in enumerate(open_.tolist()):
            cell = now[:m] + data[first[:m] + k]
            sums[:m] += COUNTS[cell]
            now[:m] = NEXT[cell]
        ends[mine], counted[mine] = now, sums
    return ends, counted


class Scan:
    """The first pass over texts in a row: ``bounds`` has where each begins and the last ends.

    ``units`` and ``sentinels`` are the counts of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = data
        length = np.diff(bounds)
        lanes = -(-length // LANE)
        self.text = np.repeat(np.arange(len(length)), lanes)
        inside = np.arange(len(self.text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        self.start = bounds[:-1][self.text] + inside * LANE
        self.size = np.minimum(LANE, bounds[1:][self.text] - self.start)
        self.state = np.zeros(len(self.text), np.int32)
        ends, counted = through(data, self.start, self.size, self.state)
        later = np.flatnonzero(inside > 0)
        while len(later):  # lanes that begin in another state than assumed
            later = later[self.state[later] != ends[later - 1]]
            self.state[later] = ends[later - 1]
            again = through(data, self.start[later], self.size[later], self.state[later])
            changed = ends[later] != again[0]
            ends[later], counted[later] = again
            later = later[changed] + 1
            later = later[later < len(inside)]
            later = later[inside[later] > 0]
        self.end, self.units_of = bounds[1:], counted & (SENTINEL - 1)
        self.before = np.cumsum(self.units_of) - self.units_of  # units of all lanes before
        self.units = np.bincount(self.text, self.units_of, len(length)).astype(np.int64)
        self.sentinels = np.bincount(self.text, counted >> 32, len(length)).astype(np.int64)
        self.base = np.cumsum(self.units) - self.units

    def cuts(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The second pass: the bytes at which these units of these texts begin; after the last unit, the text's end."""
        out = self.end[text].copy()
        inner = np.flatnonzero(unit < self.units[text])
        wanted = self.base[text[inner]] + unit[inner]
        lane = np.searchsorted(self.before + self.units_of, wanted, "right")
        left, now, first, size = wanted - self.before[lane], self.state[lane].copy(), self.start[lane], self.size[lane]
        open_ = np.arange(len(inner))
        for k in range(LANE):
            if not len(open_):
                break
            cell = now[open_] + self.data[first[open_] + k]
            begins = (COUNTS[cell] & (SENTINEL - 1)).astype(bool)
            here = begins & (left[open_] == 0)
            out[inner[open_[here]]] = first[open_[here]] + k
            left[open_] -= begins
            now[open_] = NEXT[cell]
            open_ = open_[~here & (k + 1 < size[open_])]
        return out


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """The first four groups of eight digits of the hash of an id, as numbers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transformed(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document: psm ``<P>``prefix``<S>``suffix``<M>``middle,
    spm ``<S>``suffix``<P>``prefix``<M>``middle, or plain, the text itself."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [x.as_buffer() if x.is_valid else b"" for x in batch.column(1)]
            data = np.frombuffer(b"".join(raw), np.uint8)
            h = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            bounds = np.cumsum([0, *map(len, raw)])
            del raw
            scan = Scan(data, bounds)
            n = scan.units
            form = np.where((n == 0) | (scan.sentinels > 0) | (h[:, 2] % 100 >= rate), 0, np.where(h[:, 3] % 100 < spm, 2, 1))
            ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            cut = np.flatnonzero(form)
            at = scan.cuts(np.tile(cut, 2), np.concatenate((ends[cut, 0], ends[cut, 1])))
            places = dict(zip(cut.tolist(), zip(at[: len(cut)].tolist(), at[len(cut) :].tolist(), strict=True), strict=True))
            view, out = memoryview(data), []
            for i, (kind, a, z) in enumerate(zip(form.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if not kind:
                    out.append(bytes(view[a:z]))
                    continue
                x, y = places[i]
                prefix, middle, suffix = view[a:x], view[x:y], view[y:z]
                out.append(b"".join((s, suffix, p, prefix, m, middle) if kind == 2 else (p, prefix, s, suffix, m, middle)))
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(np.array(["plain", "psm", "spm"])[form], pa.string()),
                    pa.array(ends[:, 0], pa.int64(), mask=plain),
                    pa.array(ends[:, 1] - ends[:, 0], pa.int64(), mask=plain),
                    pa.array(out, pa.binary()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), draws(F.col("doc_id"), seed).alias("draws"))
    found = rows.mapInArrow(common.tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made.  It holds no sentinel, so the first of each kind is the one that was set."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    k = len(PREFIX)
    part = lambda a, b: F.substring(output, a + k, b - a - k)
    middle = F.substring(output, m + k, F.length(output))
    psm, spm = F.concat(part(p, s), middle, part(s, m)), F.concat(part(p, m), middle, part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's output, and of the text that is rebuilt from it."""
    common.prepare(spark)
    t = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
OP11_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, {_H} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
