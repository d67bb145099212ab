"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 32 words. A passage is encoded as the mean of its words' learned embeddings (one by the
word's written shape and whether it repeats the word before, one by a hash of the word) through a tanh layer. A gated attention, tanh(V h) * sigmoid(U h), weighs the
passages; the weighted sum of their encodings gives the document's score. Everything is learned together from document labels
alone, by Adam on hand-written gradients, in numpy.

The fit takes at most SAMPLE_A_CLASS labelled documents of each class, those with the least hash of doc_id, all outside the
held-out fold (crc32 of doc_id as text, mod 5, is 0), and of each at most MOST_PASSAGES passages, evenly spread. Tasks encode
them, so that the driver gets a bounded number of bytes a document. Every document's whole text is scored. Neither labels, lang, source nor
doc_id is an input.

Defined cases: null and empty texts have one passage without words and are scored by the biases alone; null labels are left
out; of repeated labels the greatest counts, of rows that repeat a doc_id the least text is learned from; without any usable label each score is 0.5; an empty table gives an empty
result; very long texts are scored in pieces of bounded memory; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracework.llm.common import least_hashed, released

PASSAGE = 32
SHAPES, HASHES, DIM, HIDDEN, ATTENTION = 2048, 2048, 8, 12, 8
SAMPLE_A_CLASS, MOST_PASSAGES = 1000, 64
EPOCHS, BATCH, RATE = 6, 32, 0.01
THRESHOLD = 0.3
#: Bytes of text that are encoded at a time.
PIECE = 1 << 20

_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 mark, 5 beyond ASCII
_CLASS[:] = 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, shape codes, hash codes) of the words in an array of bytes."""
    kind = _CLASS[data]
    inside = kind > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.int32), np.zeros(0, np.int32)
    spans = edge if ends[-1] < len(data) else edge[:-1]
    count = [np.add.reduceat((kind == k).astype(np.int32), spans)[0::2] for k in (2, 3, 4, 5)]
    upper, digit, mark, wide = count
    length = ends - starts
    head = kind[starts] == 2
    tail = kind[ends - 1] == 4
    some = lambda x, most: np.minimum(x, most)
    shape = some(length // 4, 3)
    for part, base in ((head, 2), (some(upper - head, 2), 3), (some(digit, 1), 2), (some(mark, 3), 4), (tail, 2), (some(wide, 1), 2)):
        shape = shape * base + part
    place = np.arange(len(data), dtype=np.int64)
    place -= np.concatenate((np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))))
    powers = np.cumprod(np.full(64, 1000003, np.uint32), dtype=np.uint32)
    hashed = np.add.reduceat((data.astype(np.uint32) + np.uint32(1)) * powers[place & 63], spans, dtype=np.uint32)[0::2]
    again = np.concatenate(([False], hashed[1:] == hashed[:-1]))
    mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(32 - 11)
    return starts, ((shape * 2 + again) % SHAPES).astype(np.int32), mixed.astype(np.int32)


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shape codes, hash codes, word offsets of passages, passage offsets of documents), offsets with a last end."""
    raw = [(x or "").encode("utf-8", "replace") for x in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw])
    starts, shape, hashed = word_codes(data)
    first = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = np.diff(first)
    passages = np.maximum(1, -(-n // PASSAGE))
    bags = np.concatenate(([0], np.cumsum(passages)))
    within = np.arange(bags[-1]) - np.repeat(bags[:-1], passages)
    return shape, hashed, np.append(np.repeat(first[:-1], passages) + within * PASSAGE, first[-1]), bags


def _means(shape, hashed, offsets, p):
    """Mean word embedding of each passage; passages without words get zeros."""
    size = np.diff(offsets)
    full = size > 0
    out = np.zeros((len(size), 2 * DIM), np.float32)
    if full.any():
        at = offsets[:-1][full]
        out[full, :DIM] = np.add.reduceat(p["shape"][shape], at, axis=0)
        out[full, DIM:] = np.add.reduceat(p["word"][hashed], at, axis=0)
        out[full] /= size[full, None]
    return out


def _forward(x, bags, p):
    h = np.tanh(x @ p["w1"] + p["b1"])
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * g) @ p["a"]
    at, n = bags[:-1], np.diff(bags)
    w = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
    w /= np.repeat(np.add.reduceat(w, at), n)
    z = np.add.reduceat(h * w[:, None], at, axis=0)
    y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
    return h, t, g, w, z, y


def start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    normal = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    return {"shape": normal(SHAPES, DIM), "word": normal(HASHES, DIM), "w1": normal(2 * DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, ATTENTION), "u": normal(HIDDEN, ATTENTION), "a": normal(ATTENTION), "c": normal(HIDDEN), "d": np.zeros(1, np.float32)}


def gradients(shape, hashed, offsets, bags, target, weight, p):
    """Gradients of the weighted cross entropy for one batch of documents."""
    x = _means(shape, hashed, offsets, p)
    h, t, g, w, z, y = _forward(x, bags, p)
    n = np.diff(bags)
    dy = (weight * (y - target) / len(target)).astype(np.float32)
    out = {"c": z.T @ dy, "d": np.array([dy.sum()], np.float32)}
    dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
    dw = (dz * h).sum(1)
    de = w * (dw - np.repeat(np.add.reduceat(w * dw, bags[:-1]), n))
    out["a"] = (t * g).T @ de
    dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
    out["v"], out["u"] = h.T @ dt, h.T @ dg
    dh = (dz * w[:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
    out["w1"], out["b1"] = x.T @ dh, dh.sum(0)
    size = np.diff(offsets)
    dx = np.repeat((dh @ p["w1"].T) / np.maximum(size, 1)[:, None], size, axis=0)
    for name, codes, part in (("shape", shape, dx[:, :DIM]), ("word", hashed, dx[:, DIM:])):
        flat = (codes[:, None] * DIM + np.arange(DIM)).ravel()
        out[name] = np.bincount(flat, part.ravel(), p[name].size).reshape(p[name].shape)
    return out


def passages_of(text: str | None, most: int = MOST_PASSAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape codes, hash codes, words of each passage) of at most `most` passages of a text, evenly spread."""
    shape, hashed, offsets, _ = encoded([text])
    size = np.diff(offsets)
    if len(size) > most:
        chosen = np.unique(np.linspace(0, len(size) - 1, most).astype(np.int64))
        words = np.isin(np.repeat(np.arange(len(size)), size), chosen)
        shape, hashed, size = shape[words], hashed[words], size[chosen]
    return shape.astype(np.int16), hashed.astype(np.int16), size.astype(np.int16)


def fit(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> dict[str, np.ndarray] | None:
    """Parameters learned from documents as passages_of() gives them, or None where there is nothing to learn from. Classes are weighed alike."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    p, r = start(seed), np.random.default_rng(seed)
    one, two = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(docs))
        for lot in np.array_split(order, max(1, len(order) // BATCH)):
            chosen = [docs[i] for i in lot]
            m = np.cumsum([0] + [len(x[2]) for x in chosen])
            offsets = np.concatenate(([0], np.cumsum(np.concatenate([x[2] for x in chosen]), dtype=np.int64)))
            got = gradients(np.concatenate([x[0] for x in chosen]).astype(np.int32), np.concatenate([x[1] for x in chosen]).astype(np.int32), offsets, m, y[lot], weight[lot], p)
            step += 1
            for k, v in got.items():
                one[k] += 0.1 * (v - one[k])
                two[k] += 0.01 * (v * v - two[k])
                p[k] -= (RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def scores(texts: list[str | None], p: dict[str, np.ndarray] | None) -> np.ndarray:
    """Scores of whole texts, in pieces of about PIECE bytes; a longer text is a piece of its own."""
    if p is None:
        return np.full(len(texts), 0.5)
    out, lot, size = [], [], 0
    for x in [*texts, None]:
        if lot and (size + len(x or "") > PIECE or len(out) + len(lot) == len(texts)):
            shape, hashed, offsets, bags = encoded(lot)
            out.extend(_forward(_means(shape, hashed, offsets, p), bags, p)[-1].tolist())
            lot, size = [], 0
        lot.append(x)
        size += len(x or "")
    return np.asarray(out, np.float64)[: len(texts)]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_A_CLASS) -> dict[str, np.ndarray] | None:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = least_hashed(usable, "quality", per_class)  # at most per_class rows a class
    if not len(ids):
        return None
    few = docs.sparkSession.createDataFrame([(int(i), int(q)) for i, q in ids.itertuples(index=False)], "id bigint, quality int")

    def encode(batches):
        for b in batches:
            parts = [[x.tobytes() for x in passages_of(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("quality"), *[pa.array([x[k] for x in parts], pa.binary()) for k in range(3)]], ["id", "quality", "shape", "word", "size"])

    chosen = docs.join(F.broadcast(few), F.col("doc_id") == F.col("id")).groupBy("id", "quality").agg(F.min("text").alias("text"))
    rows = chosen.mapInArrow(encode, "id bigint, quality int, shape binary, word binary, size binary").toPandas()
    rows = rows.sort_values("id")
    return fit([tuple(np.frombuffer(x, np.int16) for x in r) for r in rows[["shape", "word", "size"]].itertuples(index=False)], rows["quality"].tolist())


def scored_column(docs: DataFrame) -> str:
    """The name of the score's column, which no column of docs has."""
    name = "_ql_score"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """docs with the column scored_column(docs): narrow, Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(scored_column(docs), DoubleType(), False)])

    def run(batches):
        for b in batches:
            yield b.append_column(schema.names[-1], pa.array(scores(b.column("text").to_pylist(), shared.value), pa.float64()))
        released()

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), F.col("_ql_score").alias("score"), F.when(F.col("_ql_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not rejected."""
    return scored(docs, learn(docs, labels)).filter(F.col(scored_column(docs)) >= THRESHOLD).select(*docs.columns)

