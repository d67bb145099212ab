"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes, whole, in segments of 64. In each segment one gated recurrent unit runs forwards and one
backwards; together they label every byte position with a probability for each language. A document's probability of a
language is the mean of its positions'. Parameters are learned in numpy by backpropagation through time, with Adam, from at
most SAMPLE_A_LANGUAGE documents of each language (those with the least hash of doc_id, outside the held-out fold: crc32 of
doc_id as text, mod 3, is 1), and PARTS segments of each, evenly spread. Tasks cut the segments, so that the driver gets a few
hundred bytes a document.

Defined cases: a text that is null or has no letter (Unicode categories L) is 'und' with score 0; null languages are not learned; with nothing to
learn from, all is 'und'; an empty table gives an empty result; very long texts run in blocks of bounded memory; lang,
source, doc_id and other columns are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracework.llm.common import least_hashed, released

STEPS, HIDDEN = 64, 8
SAMPLE_A_LANGUAGE, PARTS = 150, 6
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Segments that run together.
LANES = 1024
UNKNOWN = "und"


def start(n_languages: int, seed: int = 11) -> dict[str, np.ndarray]:
    """e: gate inputs of each byte (256 is padding), of both directions side by side; u, v: recurrent weights; o, b: labels."""
    r = np.random.default_rng(seed)
    normal = lambda s, *shape: (r.standard_normal(shape) * s).astype(np.float32)
    return {"e": normal(0.3, 257, 2, 3 * HIDDEN), "u": normal(0.3, 2, HIDDEN, 2 * HIDDEN), "v": normal(0.3, 2, HIDDEN, HIDDEN), "o": normal(0.3, 2 * HIDDEN, n_languages), "b": np.zeros(n_languages, np.float32)}


def _both(lanes: np.ndarray) -> np.ndarray:
    """Forward and reversed segments, (2, lanes, steps)."""
    return np.stack((lanes, lanes[:, ::-1]))


def _soft(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function here, a few times faster than tanh."""
    np.abs(x, out=spare)
    spare += 1
    return np.divide(x, spare, out=x)


def forward(lanes: np.ndarray, p: dict[str, np.ndarray], keep: list | None = None) -> np.ndarray:
    """Hidden states (2, steps, lanes, HIDDEN), both in reading order. Gates are (1 + soft) / 2. keep: gets what the gradient needs."""
    k, n = HIDDEN, len(lanes)
    codes = np.ascontiguousarray(lanes.T).astype(np.intp)
    e = np.ascontiguousarray(p["e"].transpose(1, 0, 2))
    h = np.zeros((2, n, k), np.float32)
    out = np.empty((2, STEPS, n, k), np.float32)
    x, y, s, s2 = np.empty((2, n, 3 * k), np.float32), np.empty((2, n, 2 * k), np.float32), np.empty((2, n, 2 * k), np.float32), np.empty((2, n, k), np.float32)
    for t in range(STEPS):
        np.take(e[0], codes[t], 0, out=x[0], mode="clip")
        np.take(e[1], codes[STEPS - 1 - t], 0, out=x[1], mode="clip")
        g = np.matmul(h, p["u"], out=y)
        g += x[:, :, : 2 * k]
        g = _soft(g, s)
        g += 1
        g *= 0.5
        z, r = g[:, :, :k], g[:, :, k:]
        c = (r * h) @ p["v"]
        c += x[:, :, 2 * k :]
        c = _soft(c, s2)
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), c))
        h = h + z * (c - h)
        out[0, t], out[1, STEPS - 1 - t] = h[0], h[1]
    return out


def _slope(gate: np.ndarray) -> np.ndarray:
    """Derivative of (1 + soft(x)) / 2, from its value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


def position_probabilities(out: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """(steps, lanes, languages)."""
    y = out[0] @ p["o"][:HIDDEN] + out[1] @ p["o"][HIDDEN:] + p["b"]
    y -= y.max(-1, keepdims=True)
    np.exp(y, y)
    y /= y.sum(-1, keepdims=True)
    return y


def gradients(lanes: np.ndarray, target: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy over all positions of all lanes, by backpropagation through time."""
    keep: list = []
    out = forward(lanes, p, keep)
    dy = position_probabilities(out, p)
    dy[:, np.arange(len(lanes)), target] -= 1
    dy *= (lanes.T != 256)[:, :, None] / np.float32(max(1, (lanes != 256).sum()))
    both = np.concatenate((out[0], out[1]), -1)
    g = {"o": both.reshape(-1, 2 * HIDDEN).T @ dy.reshape(-1, dy.shape[-1]), "b": dy.sum((0, 1))}
    dout = dy @ p["o"].T
    g |= {k: np.zeros_like(p[k]) for k in ("e", "u", "v")}
    dh, codes, k = np.zeros((2, len(lanes), HIDDEN), np.float32), _both(lanes), HIDDEN
    for t in reversed(range(STEPS)):
        h, z, r, c = keep[t]
        dh = dh + np.stack((dout[t, :, :k], dout[STEPS - 1 - t, :, k:]))
        da = dh * z * (1 - np.abs(c)) ** 2
        drh = da @ p["v"].transpose(0, 2, 1)
        g["v"] += (r * h).transpose(0, 2, 1) @ da
        dz, dr = dh * (c - h) * _slope(z), drh * h * _slope(r)
        gates = np.concatenate((dz, dr), -1)
        g["u"] += h.transpose(0, 2, 1) @ gates
        step = np.concatenate((gates, da), -1)
        for d in (0, 1):
            np.add.at(g["e"][:, d], codes[d, :, t], step[d])
        dh = dh * (1 - z) + drh * r + gates @ p["u"].transpose(0, 2, 1)
    return g


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, lanes of each text): every byte of every text, the last segment padded with 256."""
    n = np.array([max(1, -(-len(x) // STEPS)) for x in texts])
    lanes = np.full(n.sum() * STEPS, 256, np.int16)
    at = np.concatenate(([0], np.cumsum(n)[:-1])) * STEPS
    for x, k in zip(texts, at, strict=True):
        lanes[k : k + len(x)] = np.frombuffer(x, np.uint8)
    return lanes.reshape(-1, STEPS), n


def some_segments(text: str, most: int = PARTS) -> np.ndarray:
    """At most `most` segments of a text, evenly spread."""
    own, _ = segments([text.encode("utf-8", "replace")])
    return own[np.unique(np.linspace(0, len(own) - 1, most).astype(np.int64))]


def fit(parts: list[np.ndarray], langs: list[str], seed: int = 11) -> dict | None:
    """Parameters, learned from segments of each document, and the languages' names."""
    names = sorted(set(langs))
    if not names:
        return None
    r = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(names)}
    lanes, y = np.concatenate(parts), np.repeat([number[x] for x in langs], [len(x) for x in parts])
    p = start(len(names), seed)
    one, two, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = r.permutation(len(lanes))
        for lot in np.array_split(order, max(1, len(order) // BATCH)):
            step += 1
            for k, v in gradients(lanes[lot], y[lot], p).items():
                one[k] += 0.1 * (v - one[k])
                two[k] += 0.01 * (v * v - two[k])
                p[k] -= (RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p | {"names": names}


def pooled(texts: list[bytes], p: dict) -> np.ndarray:
    """Mean probability of each language over all positions, (texts, languages)."""
    lanes, n = segments(texts)
    total = np.empty((len(lanes), len(p["names"])), np.float64)
    for k in range(0, len(lanes), LANES):
        block = lanes[k : k + LANES]
        y = position_probabilities(forward(block, p), p)
        if (block[:, -1] == 256).any():
            y *= (block.T != 256)[:, :, None]
        total[k : k + LANES] = y.sum(0)
    sums = np.add.reduceat(total, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0)
    return sums / np.maximum(1, [len(x) for x in texts])[:, None]


def predictions(texts: list[str | None], p: dict | None) -> tuple[list[str], list[float]]:
    """Language and probability of each text, 'und' for null; blocks of about LANES segments run at a time."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if p is None:
        return langs, scores
    lot: list[int] = []
    raw: list[bytes] = []
    size = 0

    def flush():
        nonlocal lot, raw, size
        if lot:
            y = pooled(raw, p)
            for i, k, v in zip(lot, y.argmax(1), y.max(1), strict=True):
                langs[i], scores[i] = p["names"][k], float(min(1.0, v))
        lot, raw, size = [], [], 0

    for i, x in enumerate(texts):
        if x is not None:
            b = x.encode("utf-8", "replace")
            lot.append(i)
            raw.append(b)
            size += len(b)
            if size > 2 * LANES * STEPS:
                flush()
    flush()
    return langs, scores


def learn(docs: DataFrame, per_language: int = SAMPLE_A_LANGUAGE) -> dict | None:
    """Fit on a bounded sample of the documents outside the held-out fold."""
    usable = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text")) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    ids = least_hashed(usable.select("doc_id", "lang"), "lang", per_language)  # at most per_language rows a language
    if not len(ids):
        return None
    few = docs.sparkSession.createDataFrame(sorted((int(i), x) for i, x in ids.itertuples(index=False)), "id bigint, known string")

    def cut(batches):
        for b in batches:
            lanes = [some_segments(x).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(lanes, pa.binary())], ["id", "lang", "lanes"])

    found = usable.join(F.broadcast(few), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("known"))).groupBy("id", "lang").agg(F.min("text").alias("text"))
    rows = found.mapInArrow(cut, "id bigint, lang string, lanes binary").toPandas()
    rows = rows.sort_values(["id", "lang"])
    return fit([np.frombuffer(x, np.int16).reshape(-1, STEPS) for x in rows["lanes"]], rows["lang"].tolist())


def has_letter(text: Column) -> Column:
    """Whether a text has a letter: a character of the Unicode categories L."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, _lang, _score) of each document: narrow, Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([docs.schema["doc_id"], StructField("_lang", StringType(), False), StructField("_score", DoubleType(), False)])

    def run(batches):
        for b in batches:
            langs, scores = predictions(b.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)
        released()

    return docs.select("doc_id", F.when(has_letter(F.col("text")), F.col("text")).alias("text")).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    model = learn(docs)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return identified(docs, model).select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
