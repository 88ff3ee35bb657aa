"""Content-addressed store of token ids.

Every document is encoded and its id stream cut into chunks where a rolling hash of the last ids says so
(content-defined: an insertion moves only the cuts near it).  A chunk is named by its digest and stored
once; a document is a recipe, the list of its chunks; Merkle roots over chunk digests verify what is
read back.

Layout in the shared folder: pack files hold compressed blocks of chunks and an index.  The first pass
writes one pack per task, without repeats inside it; only digests then go through Spark to find chunks
that several packs hold; a second pass rewrites each pack without the chunks another pack owns.  Payloads
are never shuffled.  Recipes, in ascending doc_id order with the position of each document in the whole
stream, are a Parquet table beside the packs.

Pack format: b"MRPACK1\\n", blocks (zstd, raw little-endian ids of ``width`` bytes), index (zlib, JSON:
width, blocks [offset, bytes], chunks [digest, block, first id, ids]), 8 bytes length of the index, b"MRPACKE\\n".

Defined cases: a null or empty text has the end id only; null ids come first; repeated rows are documents
of their own, in any order among equals; the string of a special token in a text is that token, as the library has it; very long texts are
encoded in slices and stored in chunks; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.tokens import mixed, sums

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Rolling window, average (a power of two), least and most ids of a chunk; raw bytes of a block.
WINDOW, AVERAGE, LEAST, MOST, BLOCK = 8, 1024, 128, 8192, 1 << 18
HEAD, TAIL = b"MRPACK1\n", b"MRPACKE\n"
#: Pieces whose ids a worker remembers: as strings, and by hash; bytes of the latter; bytes of text encoded at once.
REMEMBERED, HASHED, HELD, PIECE = 100_000, 1_000_000, 16 << 20, 1 << 19

# The pre-tokenizer's pattern over characters up to U+024F and general punctuation, where Python's re and
# the library agree; texts with other characters go to the library as a whole.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
SPACED = re.compile(f" [{LETTER}]+").fullmatch
OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞]")


#: Characters of which one or another may be such; without any of them only blanks in a row need looking for.
SUSPECT, BLANKS = re.compile("[^\n\x20-&(-~¡-ɏ‐-‧‰-⁞]"), ("  ", "\n\n", " \n", "\n ")
#: White space in a row and contractions, where pieces are more than runs of one class of characters.
ODD = re.compile(r"\s\s|'(?:s|t|re|ve|m|ll|d)")
SYMBOL, ALPHA, DIGIT, SPACE, BLANK = range(5)
_of = lambda c: SPACE if c == " " else BLANK if c.isspace() else ALPHA if re.match(f"[{LETTER}]", c) else DIGIT if re.match(f"[{NUMBER}]", c) else SYMBOL
#: Classes of characters up to U+024F, and of first bytes (those of two-byte characters are set by the character).
POINTS = np.array([_of(chr(c)) for c in range(0x800)], np.uint8)
CLASSES = np.where(np.arange(256) < 128, np.resize(POINTS[:128], 256), SYMBOL).astype(np.uint8)


class Encoder:
    """Encodes whole texts; the ids of each piece of text between the pre-tokenizer's cuts are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes for special tokens; texts with one go through it whole.
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True
        self.known: dict[str, bytes] = {}
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces.  A space and letters always are one piece, so those go through the library as
        one text; the ids that carry the space tell where each begins."""
        words = list(filter(SPACED, pieces))
        rest = list(pieces.difference(words))
        for piece, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(e.ids, self.dtype).tobytes()
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.append(np.flatnonzero(self.spaced[ids])[1:], len(ids)) * ids.itemsize
            if len(ends) != len(words):
                raise ValueError("the library cut words otherwise than the pattern")
            raw, last = ids.tobytes(), 0
            for word, end in zip(words, ends.tolist(), strict=True):
                self.known[word] = raw[last:end]
                last = end

    def remembered(self, pieces: list[str]) -> list[bytes]:
        """Raw ids of pieces that were perhaps not seen before; each is encoded once."""
        self.learn(set(pieces).difference(self.known))
        return [self.known.pop(p) for p in pieces]

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        # Of each known piece: where its ids and its bytes begin, and how many they are.
        self.at, self.size, self.from_, self.length = (np.zeros(0, np.int32) for _ in range(4))
        self.flat, self.bytes = np.zeros(0, self.dtype), np.zeros(0, np.uint8)

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts of known characters without contractions and white space in a row.

        There a piece begins where the class of characters changes, but for a space, which begins the piece of
        what follows it.  So the texts can be cut before any space, and long ones are."""
        raw = [t.encode() for t in texts]
        data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        del raw
        ids, starts, ends, begin, count = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0, 0
        cut = np.append(data == 32, True)
        cut[bounds] = True
        safe = np.flatnonzero(cut)
        while begin < len(data):
            k = int(np.searchsorted(safe, begin + PIECE, "right"))
            to = int(safe[k - 1]) if safe[k - 1] > begin else int(safe[k])
            part, first, size = self.encode_slice(data[begin:to], bounds[(bounds >= begin) & (bounds < to)] - begin)
            ids.append(part)
            starts.append(first + begin)
            ends.append(count + np.cumsum(size))
            begin, count = to, count + len(part)
        first, ends = np.concatenate(starts), np.concatenate(ends)
        at = ends[np.searchsorted(first, bounds)]
        return np.insert(np.concatenate(ids), at[1:], END_ID), at + np.arange(len(at))

    def encode_slice(self, data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece begins, how many ids it has) of plain texts that begin at ``inner``.

        Pieces are looked up by hash and then compared byte by byte with the piece that is known by it; where one
        differs, the slice is looked up by its strings."""
        n = len(data)
        kind = CLASSES[data]
        two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        kind[two] = kind[two + 1] = POINTS[(data[two].astype(np.int32) & 0x1F) << 6 | data[two + 1] & 0x3F]
        starts = np.ones(n, bool)
        starts[1:] = ((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)) | (kind[1:] == SPACE)
        starts[inner] = True
        first = np.flatnonzero(starts).astype(np.int32)
        last = np.append(first[1:], np.int32(n))
        total = sums(data, first)
        u, where, inverse = np.unique(mixed(total[last] - total[first]), return_index=True, return_inverse=True)
        del total
        if len(self.hashes) > HASHED or len(self.bytes) > HELD or self.flat.nbytes > HELD:
            self.forget()
        slot = np.searchsorted(self.hashes, u)
        new = np.flatnonzero(self.hashes[np.minimum(slot, len(self.hashes) - 1)] != u if len(self.hashes) else np.ones(len(u), bool))
        if len(new):
            pieces = [data[a:b].tobytes() for a, b in zip(first[where[new]].tolist(), last[where[new]].tolist(), strict=True)]
            ids = self.remembered([p.decode() for p in pieces])
            size, length = np.array([len(x) for x in ids]) // self.flat.itemsize, np.array([len(x) for x in pieces])
            self.hashes = np.insert(self.hashes, slot[new], u[new])
            self.at = np.insert(self.at, slot[new], len(self.flat) + np.cumsum(size) - size)
            self.size = np.insert(self.size, slot[new], size)
            self.from_ = np.insert(self.from_, slot[new], len(self.bytes) + np.cumsum(length) - length)
            self.length = np.insert(self.length, slot[new], length)
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), self.dtype)))
            self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(pieces), np.uint8)))
            slot = np.searchsorted(self.hashes, u)
        slot = slot[inverse]
        length = last - first
        if (self.length[slot] != length).any() or (self.bytes[np.repeat(self.from_[slot] - first, length) + np.arange(n, dtype=np.int32)] != data).any():
            return self.encode_strings(data, first, last)
        size = self.size[slot]
        ends = np.cumsum(size, dtype=np.int32)
        return self.flat[np.repeat(self.at[slot] - (ends - size), size) + np.arange(ends[-1], dtype=np.int32)], first, size

    def encode_strings(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode_slice`` where pieces of the same hash differ."""
        pieces = [data[a:b].tobytes().decode() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        self.learn(set(pieces).difference(self.known))
        ids = [self.known[p] for p in pieces]
        return np.frombuffer(b"".join(ids), self.dtype), first, np.array([len(x) for x in ids], np.int64) // self.flat.itemsize

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and where each begins and the last ends."""
        plain = [not self.special(t) and not any(b in t for b in BLANKS) and (not SUSPECT.search(t) or not OTHER.search(t) and not ODD.search(t)) for t in texts]
        if all(plain):
            return self.encode_plain(texts)
        ids, bounds = self.encode_plain([t for t, p in zip(texts, plain, strict=True) if p])
        rest, at = self.encode_pieces([t for t, p in zip(texts, plain, strict=True) if not p])
        i = j = 0
        out = []
        for p in plain:
            if p:
                out.append(ids[bounds[i] : bounds[i + 1]])
                i += 1
            else:
                out.append(rest[at[j] : at[j + 1]])
                j += 1
        return np.concatenate(out), np.cumsum([0, *map(len, out)])

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for all other texts: pieces by the pattern, or by the library as a whole."""
        end, out = np.array([END_ID], self.dtype).tobytes(), []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [None if self.special(t) or OTHER.search(t) else PIECES.findall(t) for t in texts]
        new = set().union(*filter(None, cut)).difference(self.known)
        if new:
            self.learn(new)
        look = self.known.__getitem__
        for text, pieces in zip(texts, cut, strict=True):
            raw = b"".join(map(look, pieces)) if pieces is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
            out.append(raw + end)
        bounds = np.cumsum([0, *map(len, out)]) // self.dtype().itemsize
        return np.frombuffer(b"".join(out), self.dtype), bounds


def encoder(name: str) -> Encoder:
    return common.held(name, lambda: load_encoder(name))


def load_encoder(name: str) -> Encoder:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(public_tokenizers.path(name))


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Positions after which a stream may be cut: where the rolling hash of the last ``WINDOW`` ids has leading zeros."""
    n = len(ids)
    h = np.zeros(n, np.uint32)
    m = (mixed(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[ids & 0xFFFF]
    for k in range(min(n, WINDOW)):  # the weight of an id is a power of 3 by its distance
        h[k:] += m[: n - k] * np.uint32(3**k)
    return np.flatnonzero(h < np.uint32((1 << 32) // AVERAGE)) + 1


def cuts(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of n ids, from the marks inside it.

    The first ``LEAST`` ids are never cut, so windows that reach into the document before do not matter."""
    out, last = [], 0
    for mark in [*marks, n]:
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST or mark == n and mark > last:
            last = mark
            out.append(mark)
    return out


def name_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests; leaves and inner nodes are told apart, an odd node moves up."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else b"\0" * 16


class PackWriter:
    """Writes a pack file; ``add`` returns nothing, ``close`` the chunks' places: digest -> (offset, bytes, first, ids, width)."""

    def __init__(self, path: str, width: int):
        fs, p = common.filesystem(path)
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        self.out, self.width = fs.open_output_stream(p, compression=None), width
        self.out.write(HEAD)
        self.blocks, self.chunks, self.pending, self.size, self.ids = [], [], [], 0, 0

    def add(self, digest: bytes, raw: bytes) -> None:
        self.chunks.append((digest, len(self.blocks), self.ids, len(raw) // self.width))
        self.pending.append(raw)
        self.size, self.ids = self.size + len(raw), self.ids + len(raw) // self.width
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.pending))
            self.blocks.append((self.out.tell(), len(data)))
            self.out.write(data)
            self.pending, self.size, self.ids = [], 0, 0

    def close(self) -> dict[bytes, tuple[int, ...]]:
        self.flush()
        index = zlib.compress(json.dumps({"width": self.width, "blocks": self.blocks, "chunks": [(d.hex(), *r) for d, *r in self.chunks]}).encode(), 1)
        self.out.write(index + struct.pack("<Q", len(index)) + TAIL)
        self.out.close()
        return {d: (*self.blocks[b], first, n, self.width) for d, b, first, n in self.chunks}


class PackReader:
    """Random access to the chunks of pack files; keeps a few open files and blocks."""

    def __init__(self, kept: int = 16):
        self.kept = kept
        self.files, self.blocks = OrderedDict(), OrderedDict()

    def file(self, path: str):
        if path not in self.files:
            if len(self.files) >= self.kept:
                self.files.popitem(last=False)[1].close()
            fs, p = common.filesystem(path)
            self.files[path] = fs.open_input_file(p)
        self.files.move_to_end(path)
        return self.files[path]

    def block(self, path: str, offset: int, n: int) -> bytes:
        key = (path, offset)
        if key not in self.blocks:
            if len(self.blocks) >= self.kept:
                self.blocks.popitem(last=False)
            self.blocks[key] = zstandard.ZstdDecompressor().decompress(self.file(path).read_at(n, offset))
        self.blocks.move_to_end(key)
        return self.blocks[key]

    def chunk(self, path: str, offset: int, n: int, first: int, ids: int, width: int) -> np.ndarray:
        return np.frombuffer(self.block(path, offset, n), f"<u{width}", ids, first * width)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def index_of(path: str) -> dict:
    fs, p = common.filesystem(path)
    with fs.open_input_file(p) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if f.read_at(8, 0) != HEAD or tail[8:] != TAIL:
            raise ValueError(f"{path} is not a whole pack")
        n = struct.unpack("<Q", tail[:8])[0]
        return json.loads(zlib.decompress(f.read_at(n, size - 16 - n)))


STAGED = "pack string, doc_id long, doc string, n_tokens long, root binary, chunks array<binary>"


def write_packs(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """First pass: (pack, doc_id, doc, n_tokens, root, chunks) for each document; ``doc`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        path, out, seen, count = f"{folder}/{uuid.uuid4().hex}.pack", None, set(), 0
        for batch in batches:
            out = out or PackWriter(path, enc.dtype().itemsize)
            rows = []
            ids, bounds = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            marks = marks_of(ids)
            edges = np.searchsorted(marks, bounds, "right")
            for i in range(len(batch)):
                begin, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
                last, names = 0, []
                for at in cuts((marks[edges[i] : edges[i + 1]] - begin).tolist(), n):
                    raw = ids[begin + last : begin + at].tobytes()
                    digest = name_of(raw)
                    if digest not in seen:
                        seen.add(digest)
                        out.add(digest, raw)
                    names.append(digest)
                    last = at
                rows.append((path, f"{path[-37:-5]}/{count}", n, merkle(names), names))
                count += 1
            if rows:
                p, d, n, r, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p), batch.column(0).cast(pa.int64()), pa.array(d), pa.array(n, pa.int64()), pa.array(r, pa.binary()), pa.array(c, pa.list_(pa.binary()))],
                    ["pack", "doc_id", "doc", "n_tokens", "root", "chunks"],
                )
        if out:
            out.close()

    return common.materialize(docs.select("doc_id", "text").mapInArrow(common.tidy(run), STAGED), "recipes-staged")


def compact(staged: DataFrame, folder: str) -> DataFrame:
    """Second pass: packs without the chunks that another pack owns; (digest, path, offset, bytes, first, ids, width)."""
    held = staged.select("pack", F.explode("chunks").alias("digest")).distinct()
    owner = held.groupBy("digest").agg(F.min("pack").alias("owner"), F.count(F.lit(1)).alias("packs")).where("packs > 1")
    foreign = held.join(owner, "digest").where("pack <> owner").groupBy("pack").agg(F.collect_list("digest").alias("drop"))  # bounded by a pack's own chunks
    work = staged.select("pack").distinct().join(foreign, "pack", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, drop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gone, index = set(drop or ()), index_of(path)
                new, reader = f"{folder}/{uuid.uuid4().hex}.pack", PackReader(2)
                out = PackWriter(new, index["width"])
                for name, block, first, n in index["chunks"]:
                    if (digest := bytes.fromhex(name)) not in gone:
                        out.add(digest, reader.chunk(path, *index["blocks"][block], first, n, index["width"]).tobytes())
                reader.close()
                places = out.close()
                if places:
                    columns = list(zip(*((d, new, *p) for d, p in places.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), *[pa.int64()] * 5), strict=True)], ["digest", "path", "offset", "bytes", "first", "ids", "width"])

    spark = staged.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return common.materialize(work.repartition(n, "pack").mapInArrow(common.tidy(run), "digest binary, path string, offset long, bytes long, first long, ids long, width long"), "places")


def write_store(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write packs and recipes of all documents under ``folder``; returns the recipe table.

    A recipe has doc_id, start, n_tokens, root and the places of its chunks, in order."""
    spark = docs.sparkSession
    staging = f"{folder}/staging"
    staged = write_packs(docs, staging, tokenizer)
    places = compact(staged, f"{folder}/packs")
    common.remove(spark, staging)
    order = common.running_total(staged.select("doc", "doc_id", "n_tokens"), ["doc_id"], "n_tokens", "start", "recipe-order", extra=["doc"]).select("doc", "start")
    parts = staged.select("doc", F.posexplode("chunks").alias("seq", "digest")).join(places, "digest")
    chunk = F.struct("seq", "digest", "path", "offset", "bytes", "first", "ids", "width")
    whole = parts.groupBy("doc").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))  # bounded by the document
    recipes = staged.select("doc", "doc_id", "n_tokens", "root").join(whole, "doc").join(order, "doc")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.repartitionByRange(n, "start").sortWithinPartitions("start")
    path = f"{folder}/recipes"
    ordered.write.parquet(path)
    return spark.read.schema(ordered.schema).parquet(path)


def read_store(recipes: DataFrame) -> DataFrame:
    """Rebuild every document from the packs: doc_id, start, n_tokens, ids_crc32; raises where a digest or root is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PackReader()
        for batch in batches:
            counts, sums = [], []
            chunks = batch.column(3)
            first = chunks.offsets.to_numpy()
            digests, *places = (chunks.values.field(f).to_pylist() for f in ("digest", "path", "offset", "bytes", "first", "ids", "width"))
            places = list(zip(*places, strict=True))
            for i, root in enumerate(batch.column(2).to_pylist()):
                crc = n = 0
                for k in range(first[i], first[i + 1]):
                    ids = reader.chunk(*places[k])
                    if name_of(ids.tobytes()) != digests[k]:
                        raise ValueError(f"a chunk in {places[k][0]} is damaged")
                    crc, n = zlib.crc32(ids.astype("<u4").tobytes(), crc), n + len(ids)
                if merkle(digests[first[i] : first[i + 1]]) != root:
                    raise ValueError("a recipe is damaged")
                counts.append(n)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        reader.close()

    return recipes.select("doc_id", "start", "root", "chunks").mapInArrow(common.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    """Encode every text into the store and rebuild it from there."""
    common.prepare(spark)
    return read_store(write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), common.shared_dir(spark, "tokens")))
