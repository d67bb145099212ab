"""Packed exchange of sorted hashes between batches of documents.

Documents are dealt into batches of about BATCH bytes by a hash of doc_id and text, so that null or repeated ids spread, too. Each batch sends the sorted distinct hashes of its
items (word windows, anchors, shingles) to buckets of the hash range, delta-coded and compressed: one entry per distinct item
and batch, however often the batch holds it, so that an item which a third of all documents share costs as many entries as
there are batches. A bucket tells each batch in how many batches, or how often, every hash it sent occurs. Both sides are
recomputed alike after a lost executor, since a batch's documents are a function of doc_id and text alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import released, row_key, text_bytes

#: Bytes of text in a batch, about; what a task holds is some ten times as much.
BATCH = 6 << 20
#: Bytes of text whose items meet in one bucket, about, and the least number of batches and buckets.
BUCKET, LEAST = 12 << 20, 64
BATCHED = "batch int, doc_id long, row long, data binary"


def pack(a: np.ndarray) -> bytes:
    """An integer array, byte planes apart (high bytes are mostly alike), compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(h: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit numbers, as differences."""
    return pack(np.diff(h, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """Rows as an Arrow table."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def releasing(work):
    """A group's work that gives its memory back when it is done."""

    def run(*groups):
        try:
            return work(*groups)
        finally:
            released()

    # Spark tells the forms of these functions by the number of their arguments.
    return (lambda one: run(one)) if work.__code__.co_argcount == 1 else (lambda one, two: run(one, two))


def plan(docs: DataFrame) -> tuple[int, int, int]:
    """(batches, buckets, hash bits) for a table, from the bytes of its texts."""
    size = text_bytes(docs)
    return max(LEAST, -(-size // BATCH)), max(LEAST, -(-size // BUCKET)), min(64, max(32, size.bit_length() + 8))


def batched(docs: DataFrame, batches: int) -> DataFrame:
    """(batch, doc_id, row, data): texts as bytes, null texts empty, null doc_ids kept."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(batches)).cast("int").alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("row"), data.alias("data"))


def rows_in_order(table) -> list[int]:
    """Row hashes of a batch in the order of in_order()."""
    ids, rows = table.column("doc_id").to_pylist(), table.column("row").to_pylist()
    return [r for _, _, r in sorted((i is not None, i or 0, r) for i, r in zip(ids, rows, strict=True))]


def in_order(table) -> tuple[np.ndarray, list[bytes], list]:
    """(doc_ids as numbers, texts, doc_ids as they are) of a batch, by doc_id, nulls first, then by row hash."""
    ids = table.column("doc_id").to_pylist()
    rows = table.column("row").to_pylist()
    data = table.column("data").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, rows[i]))
    known = np.array([np.iinfo(np.int64).min if ids[i] is None else ids[i] for i in order], np.int64)
    return known, [data[i] for i in order], [ids[i] for i in order]


def sent(h: np.ndarray, bits: int, buckets: int, counts: np.ndarray | None = None) -> list[tuple[int, bytes, bytes]]:
    """(bucket, packed hashes, packed counts) of sorted distinct hashes below 2 ** bits; a bucket is an equal share of the range."""
    width = -(-(1 << bits) // buckets)
    edges = np.searchsorted(h, np.array([min(width * k, (1 << 64) - 1) for k in range(1, buckets)], np.uint64))
    cuts = np.concatenate(([0], edges, [len(h)]))
    return [(k, pack_sorted(h[a:b]), pack(counts[a:b]) if counts is not None else b"") for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def met(hashes: list[np.ndarray], counts: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For the sorted hashes of several batches: how often each occurs over all (by counts, or one a batch), at most 255."""
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    at = np.flatnonzero(new)
    n = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], at) if counts is not None else np.diff(np.append(at, len(ordered)))
    out = np.empty(len(flat), np.uint8)
    out[order] = np.minimum(n, 255).astype(np.uint8)[np.cumsum(new) - 1]
    return np.split(out, np.cumsum([len(x) for x in hashes])[:-1])


def answers(messages: DataFrame, other=None) -> DataFrame:
    """(batch, bucket, reply) for (batch, bucket, payload, counts): how often each hash sent occurs.

    Buckets below 0 are free for other messages; `other` makes the list of (batch, reply) of such a bucket's rows. All go through
    one shuffle, so that what made them runs once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch")
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            rows = other(list(pdf["payload"]))
            return pd.DataFrame({"batch": [b for b, _ in rows], "bucket": bucket, "reply": [x for _, x in rows]})
        counts = [unpack(x, np.uint8) for x in pdf["counts"]] if len(pdf["counts"].iloc[0]) else None
        got = met([unpack_sorted(x) for x in pdf["payload"]], counts)
        return pd.DataFrame({"batch": pdf["batch"].to_numpy(), "bucket": bucket, "reply": [pack(x) for x in got]})

    return messages.groupBy("bucket").applyInPandas(releasing(run), "batch int, bucket int, reply binary")
