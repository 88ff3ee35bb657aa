"""WARC archives and their chunked record table.

``write_archives`` writes one WARC/1.1 record per row into gzip archives (one member per record) in
the shared folder; payloads go through the compressor in slices.  ``read_chunks`` streams archives
back as rows (record, chunk number, bytes, digest so far), so that no record is ever held whole:
a reader holds one chunk, one hash state and one line of headers.  An archive that reaches
``ARCHIVE_BYTES`` is closed and the task goes on with a new one.

Defined cases: a null payload is empty; a null id is written without a ``WARC-Page-ID`` field and
read back as null, it is never the largest id, so the record revisits the one that is (all are responses where
all ids are null); a null URL becomes an empty target; rows that repeat an id are separate records
(all that share the response's id and payload are responses); very long payloads are written and read in
chunks; an empty table gives no archives and an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Bytes of payload in a chunk row, and the least payload for which a revisit record pays.
CHUNK_BYTES, REVISIT_BYTES = 65_536, 1000
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, chunk_no long, chunk_offset long, chunk_bytes long, chunk binary, digest string, last boolean"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest(), version=3)}"


def headers(page_id: int | None, url: str, digest: str, n: int, refers_to: int | None) -> bytes:
    """WARC and HTTP header lines of a record; a revisit keeps the HTTP headers of its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + (n if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: which record of equal long payloads the others revisit.

    Only digests are shuffled for the decision, one row for each task and payload; the payloads stay where they
    are read, as long as the table of payloads with copies is small enough to go to them."""
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    keys = base.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and keep is not null").select("digest", "keep")
    groups = common.small(common.materialize(groups, "warc-copies"))
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to")
    return base.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", refers_to)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``decide`` under ``folder``; returns the manifest (archive, records, bytes).

    Every attempt of a task writes a file of its own; only archives of attempts that Spark committed are
    in the manifest, so lost executors and repeated tasks do no harm."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = common.filesystem(folder)
        fs.create_dir(top, recursive=True)
        name, count, out = "", 0, None

        def closed() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                body = memoryview(payload.as_buffer())
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(pack.compress(headers(page_id.as_py(), url.as_py(), digest.as_py(), len(body), refers_to.as_py())))
                if refers_to.as_py() is None:
                    for at in range(0, len(body), CHUNK_BYTES):
                        out.write(pack.compress(body[at : at + CHUNK_BYTES]))
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return common.materialize(records.mapInArrow(common.tidy(write), "archive string, records long, bytes long"), "warc-manifest")


def records_of(stream: io.BufferedIOBase, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of an uncompressed WARC stream, in order; raises ValueError where it is damaged."""

    def fields() -> dict[str, str]:
        out = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends within headers")
            key, _, value = line.decode("utf-8", "replace").partition(":")
            out[key.strip().lower()] = value.strip()
        return out

    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = fields()
        left = int(head["content-length"])
        start = stream.readline()
        if not start.startswith(b"HTTP/"):
            raise ValueError("a record without HTTP headers")
        left -= len(start)
        http, line = {}, b""
        while line not in (b"\r\n", b"\n"):
            if not (line := stream.readline()):
                raise ValueError("the archive ends within headers")
            left -= len(line)
            key, _, value = line.decode("utf-8", "replace").partition(":")
            http[key.strip().lower()] = value.strip()
        n, kind = int(http["content-length"]), head["warc-type"]
        want = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
        page_id = int(head["warc-page-id"]) if "warc-page-id" in head else None
        refers = int(head["warc-refers-to-page-id"]) if "warc-refers-to-page-id" in head else None
        common_fields = (head["warc-record-id"].strip("<>"), page_id, kind, refers, n)
        if kind == "revisit":
            yield (*common_fields, 0, 0, 0, b"", want, True)
            continue
        if left != n:
            raise ValueError(f"{left} bytes of payload where {n} are announced")
        state, at, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, n - at))
            if not data and at < n:
                raise ValueError("the archive ends within a payload")
            state.update(data)
            last = at + len(data) == n
            if last and state.hexdigest() != want:
                raise ValueError(f"payload digest of {common_fields[0]} is wrong")
            yield (*common_fields, number, at, len(data), data, state.hexdigest(), last)
            at, number = at + len(data), number + 1
            if last:
                break


def read_chunks(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in column ``archive``; ``with_data`` false leaves ``chunk`` empty."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = common.filesystem(path)
                with fs.open_input_stream(p, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, 1 << 17) as stream:
                    for row in records_of(stream):
                        size += row[7]
                        rows.append(row if with_data else (*row[:8], b"", *row[9:]))
                        if len(rows) >= 2000 or with_data and size >= 8 * CHUNK_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
        if rows:
            yield batch_of(rows)

    spark = archives.sparkSession
    n = max(1, archives.count())
    return archives.select("archive").repartition(min(n, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(common.tidy(read), CHUNKS)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back, one row per page."""
    common.prepare(spark)
    manifest = write_archives(decide(spark.read.parquet(f"{sf_dir}/pages.parquet")), common.shared_dir(spark, "warc"))
    chunks = read_chunks(manifest, with_data=False)
    return chunks.where("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("chunks"))


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS keep FROM d WHERE n >= {REVISIT_BYTES} GROUP BY digest HAVING max(page_id) IS NOT NULL)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN g.keep IS NOT NULL AND g.keep IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.keep IS NOT NULL AND g.keep IS DISTINCT FROM d.page_id THEN g.keep END AS refers_to,
  CASE WHEN g.keep IS NOT NULL AND g.keep IS DISTINCT FROM d.page_id THEN 1 ELSE greatest(1, (d.n + {CHUNK_BYTES - 1}) // {CHUNK_BYTES}) END AS chunks
FROM d LEFT JOIN g ON d.digest = g.digest AND d.n >= {REVISIT_BYTES}
"""
