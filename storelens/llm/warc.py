"""WARC archives as a chunked record table.

A record's bytes, header block and payload, are cut into chunks of at most ``CHUNK_BYTES``.  The
archive is a table of rows (record_id, chunk_no, data, ...): the ``data`` of a record's chunks in
order is the record as it stands in a WARC 1.1 file, and records one after another are such a file
(``export``).  Each chunk carries the SHA-256 of the payload up to its end, so a reader verifies as
it goes and knows at which chunk a record was damaged.  Writer and readers hold one chunk at a time;
no record is put together in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import dropped, stored

CHUNK_BYTES = 1 << 20
MIN_DUPLICATE = 100
CHUNK_SCHEMA = "page_id bigint, record_id string, chunk_no int, last boolean, header_bytes int, payload_end bigint, digest binary, data binary"
_CHUNK = pa.schema(
    [("page_id", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("header_bytes", pa.int32()), ("payload_end", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())]
)
_URI = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    """A URN that the page and its payload determine, so that a rerun writes the same archive."""
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def header(kind: str, record: str, uri: str | None, digest: str, length: int, payload_bytes: int, page_id: int | None, refers_to: int | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_URI.sub('', uri or 'about:blank')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {payload_bytes}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def chunks_of(head: bytes, payload: memoryview, tail: bytes, chunk_bytes: int) -> Iterator[tuple[int, bool, int, bytes, bytes]]:
    """(chunk_no, last, payload end, digest so far, data): the header with the first piece, the tail with the last."""
    digest = hashlib.sha256()
    begin, number = 0, 0
    while True:
        piece = payload[begin : begin + chunk_bytes]
        begin += len(piece)
        digest.update(piece)
        last = begin >= len(payload)
        yield number, last, begin, digest.digest(), b"".join((head if number == 0 else b"", piece, tail if last else b""))
        if last:
            return
        number += 1


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archive of ``pages``, a record for each row, written to the shared folder.

    Of payloads of at least ``MIN_DUPLICATE`` bytes that are equal, the row with the smallest id is a
    response and the others are revisits of it (null ids come after all others); rows that repeat
    that id are responses too.  A null payload is empty; a null or malformed URL is written as
    ``about:blank`` or without its control characters.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    seen = rows.select("page_id", "sha", F.octet_length("payload").alias("n")).groupBy("page_id", "sha", "n").agg(F.count("*").alias("rows"))
    seen = stored(seen, "payloads")
    first = seen.where(F.col("n") >= MIN_DUPLICATE).groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("rows").alias("total")).where("total > 1")
    again = seen.join(first, "sha").where("first IS NOT NULL AND (page_id IS NULL OR page_id <> first)").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first")
    again = stored(again, "revisits")  # a table of known size: payloads stay where they are while it's small enough to broadcast
    typed = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "payload", "sha", "first")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            column = batch.column(2)
            for k, (page, url, sha, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                payload = memoryview(column[k].as_buffer())
                name = record_id(page, sha)
                kind = "response" if first is None else "revisit"
                body = payload if first is None else payload[:0]
                head = header(kind, name, url, sha, len(body), len(payload), page, first)
                for number, last, end, digest, data in chunks_of(head, body, b"\r\n\r\n", chunk_bytes):
                    rows.append((page, name, number, last, len(head), end, digest, data))
                    size += len(data)
                    if size >= 4 * chunk_bytes:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    archive = stored(typed.mapInArrow(cut, CHUNK_SCHEMA), "warc")
    dropped(seen, again)
    return archive


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK, strict=True)], schema=_CHUNK)


def parse_header(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, n_chunks int"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("n_chunks", pa.int32())])


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each record, of chunk rows sorted by record and number; a chunk is held at a time."""
    head: dict[str, str] = {}
    digest, left, expected, size = hashlib.sha256(), 0, 0, 0
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            name, number, last, header_bytes, so_far = (batch.column(c)[k].as_py() for c in (1, 2, 3, 4, 6))
            data = memoryview(batch.column(7)[k].as_buffer())
            if number == 0:
                head = parse_header(bytes(data[:header_bytes]))
                data = data[header_bytes:]
                digest, left, expected, size = hashlib.sha256(), int(head["content-length"]), 0, 0
            if number != expected:
                raise ValueError(f"{name}: chunk {expected} is missing")
            body, tail = data[:left], data[left:]
            digest.update(body)
            left -= len(body)
            size += len(body)
            expected += 1
            if digest.digest() != so_far:
                raise ValueError(f"{name}: chunk {number} is damaged")
            if last:
                wanted = head["warc-payload-digest"].removeprefix("sha256:")
                whole, stated = head["warc-type"] == "response", int(head["x-payload-length"])
                if left or bytes(tail) != b"\r\n\r\n" or (whole and (digest.hexdigest(), size) != (wanted, stated)):
                    raise ValueError(f"{name}: the record is damaged")
                out.append((_number(head["x-page-id"]), size if whole else stated, digest.hexdigest() if whole else wanted, head["warc-type"], _number(head.get("x-refers-to-page-id")), name, expected))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)


def read_archive(chunks: DataFrame) -> DataFrame:
    """A row for each record of an archive: its chunks are streamed in order and verified.

    Digest and length of a response are those of the bytes read, and must be those of its header; a
    revisit has no payload of its own and gives those of its header.  Rows of pages that repeat whole
    have equal records; a long one is verified once, and each of its rows returns.
    """
    columns = ["page_id", "record_id", "chunk_no", "last", "header_bytes", "payload_end", "digest", "data"]
    single = chunks.select(*columns).where("chunk_no = 0 AND last").mapInArrow(_verify, READ_SCHEMA)
    long = chunks.select(*columns).where("NOT (chunk_no = 0 AND last)").dropDuplicates(["record_id", "chunk_no"])
    heads = chunks.where("chunk_no = 0 AND NOT last").select("record_id")
    many = long.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_verify, READ_SCHEMA)
    many = heads.join(stored(many, "verified"), "record_id")
    return single.union(many.select(*single.columns))


def export(chunks: DataFrame, out: BinaryIO) -> None:
    """Write an archive as one WARC file, a chunk at a time."""
    for row in chunks.orderBy("record_id", "chunk_no").select("data").toLocalIterator():
        out.write(row["data"])


def import_file(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of an uncompressed WARC file that is read as a stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        raw = line
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw += line
        raw += line
        head = parse_header(raw)
        left, number, digest, end = int(head["content-length"]), 0, hashlib.sha256(), 0
        while True:
            piece = stream.read(min(left, chunk_bytes))
            if len(piece) < min(left, chunk_bytes):
                raise ValueError("the file ends within a record")
            left -= len(piece)
            end += len(piece)
            digest.update(piece)
            data = (raw if number == 0 else b"") + piece + (b"\r\n\r\n" if not left else b"")
            yield _number(head.get("x-page-id")), head["warc-record-id"], number, not left, len(raw), end, digest.digest(), data
            number += 1
            if not left:
                break


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as an archive and report what is read back from it, a row for each page.

    Nulls, long payloads, repeated rows and ties are treated as in ``write_archive``; an empty table
    gives no rows; columns other than id, URL and HTML aren't read.
    """
    return read_archive(write_archive(pages))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM q GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q JOIN f USING (h)
"""
