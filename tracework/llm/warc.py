"""WARC archives: writing, normalising a monolithic gzip stream into one member per record, and reading by offset.

`write_archive` makes what crawlers with a plain gzip pipe make: one gzip stream over a whole file of WARC records.
`normalise` inflates such a stream once, front to back in bounded memory, and writes every record as a gzip member of its own
beside a sidecar index (offset, length, id, type, one line a record), so that any record can be read alone. `read_members`
reads records by that index and checks that both agree. Files lie in the folder that driver and executors share, named by task attempt, so that a
repeated task never meets half a file.

Of pages with equal payloads of at least `min_bytes` bytes the one with the smallest page_id is written as response, the
others as revisit records without payload, which carry digest and length and refer to the response.

Defined cases: null html is the empty payload; a null page_id is written as an empty id, never is the smallest beside others,
and comes back null; rows that tie for the smallest page_id are all responses; control characters in a url are percent-coded;
an empty table writes nothing and gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import checkpointed, released, scratch_path

CHUNK = 1 << 18
#: Bytes of payloads that one archive holds, about.
ARCHIVE = 32 << 20
ARCHIVE_SCHEMA = "path string, size long"
PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, a response or a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    known = lambda x: "" if x is None else x
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{known(page_id)}>", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{known(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(out: BinaryIO, records: Iterator[bytes], level: int = 3) -> int:
    """One gzip stream over all records; how many there were."""
    z, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    for x in records:
        out.write(z.compress(x))
        n += 1
    out.write(z.flush())
    return n


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in bounded chunks. A file that ends within a member is an error."""
    z, begun = zlib.decompressobj(31), False
    while chunk := source.read(CHUNK):
        while chunk:
            yield z.decompress(chunk, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            chunk, begun = z.unused_data, not z.eof
            if z.eof:
                z = zlib.decompressobj(31)
    if begun:
        raise ValueError("the archive ends within a gzip member")


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of an archive; one record is held at a time."""
    stream, held = inflated(source), bytearray()
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if (more := next(stream, None)) is None:
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
            held += more
        h = headers(bytes(held[:end]))
        whole = end + 4 + int(h["content-length"]) + 4
        while len(held) < whole:
            if (more := next(stream, None)) is None:
                raise ValueError("the archive ends within a record")
            held += more
        yield h, bytes(held[:whole])
        del held[:whole]


def normalise(source: BinaryIO, out: BinaryIO, index: BinaryIO) -> Iterator[tuple[int, int]]:
    """Rewrite an archive record by record; yields each member's offset and length, and writes them to the index."""
    at = 0
    for h, whole in records(source):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(whole) + z.flush()
        out.write(member)
        index.write(f"{at}\t{len(member)}\t{h['warc-record-id']}\t{h['warc-type']}\n".encode())
        yield at, len(member)
        at += len(member)


def read_index(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, record id, type) of each line of a sidecar index."""
    for line in data.splitlines():
        at, length, name, kind = line.decode().split("\t")
        yield int(at), int(length), name, kind


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one gzip member."""
    whole = zlib.decompress(data, 31)
    head, _, block = whole[:-4].partition(b"\r\n\r\n")
    return headers(head), block.partition(b"\r\n\r\n")[2]


def archived(decided: DataFrame, folder: str) -> DataFrame:
    """(path, size) of every archive after writing and normalising; decided has page_id, url, html, kind, refers_to."""

    def run(batches):
        task = TaskContext.get()
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        name, lot, size, n = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}", [], 0, 0

        def flush():
            part = f"{name}-{n}"
            with store.open_output_stream(f"{part}.source.warc.gz", compression=None) as out:
                write_archive(out, iter(lot))
            with store.open_input_stream(f"{part}.source.warc.gz", compression=None) as source, store.open_output_stream(f"{part}.warc.gz", compression=None) as out, store.open_output_stream(f"{part}.idx") as index:
                found = list(normalise(source, out, index))
            store.delete_file(f"{part}.source.warc.gz")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{part.rpartition('/')[2]}"]), pa.array([sum(x for _, x in found)], pa.int64())], ["path", "size"])

        for b in batches:
            columns = [b.column(c) for c in ("kind", "page_id", "url", "html", "refers_to")]
            for k in range(b.num_rows):  # one payload at a time
                kind, page, url, html, refers = (c[k].as_py() for c in columns)
                payload = (html or "").encode("utf-8")
                lot.append(record(kind, page, url, payload, digest_of(payload), refers))
                size += len(lot[-1])
                if size >= ARCHIVE:
                    yield flush()
                    lot, size, n = [], 0, n + 1
        if lot:
            yield flush()
        released()

    return decided.select("page_id", "url", "html", "kind", "refers_to").mapInArrow(run, ARCHIVE_SCHEMA)


def read_members(archives: DataFrame) -> DataFrame:
    """One row a record of (path, size) archives: each is read record by record at the offsets that its sidecar index gives."""

    def rows_of(path: str):
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        store, at = opened(path)
        with store.open_input_stream(f"{at}.idx") as f:
            index = f.read()
        with store.open_input_file(f"{at}.warc.gz") as source:
            for offset, length, name, kind in read_index(index):
                h, payload = read_member(source.read_at(length, offset))
                full = kind == "response"
                if (h["warc-record-id"], h["warc-type"]) != (name, kind) or full and digest_of(payload) != h["warc-payload-digest"].removeprefix("sha1:"):
                    raise ValueError(f"{path}: the record at {offset} does not match its index or digest")
                yield number(name), len(payload) if full else int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), kind, None if full else number(h["warc-refers-to"])

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column("path").to_pylist():
                columns = list(zip(*rows_of(path), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        released()

    return archives.mapInArrow(run, PAGE_SCHEMA)


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with kind and refers_to. The least page_id of each payload is found by a combining aggregation over digests alone."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", "html").withColumn("_digest", F.when(F.octet_length(html) >= min_bytes, F.sha1(F.encode(html, "UTF-8"))))
    first = base.filter("_digest IS NOT NULL").groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    out = base.join(first, "_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.withColumns({"kind": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))})


def digest(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back every page."""
    folder = scratch_path(pages.sparkSession, "warc")
    made = checkpointed(archived(decided(pages), folder))
    return read_members(made.repartition(max(1, made.count())))  # a task an archive


#: DuckDB SQL for digest(); base 32 from five hexadecimal digits at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(x::BLOB) AS n, min(page_id) OVER (PARTITION BY h) AS f,
    list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (k // 4 * 5 + 1)::INT, 5))::BIGINT) >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS b
  FROM p
)
SELECT page_id, n AS payload_bytes, b AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM d
"""
SQL = SQL.replace("octet_length(x::BLOB)", "strlen(x)")
