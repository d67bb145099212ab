"""Benchmark decontamination by template canonicalisation.

Words are stripped of marks and folded; numbers (also in words, and glued to a unit as in 12kg), units after a number and names
(capitalised within a sentence) become typed placeholders. Windows of ten consecutive template words (of all words, where an item has
fewer) are hashed and joined with the benchmark's; those with fewer than five plain words, which any text could fill, are hashed by
their folded words instead. A window whose first word is a name or unit only by the word before it is hashed with this word as it is,
too, so that a copy is found after any word. A window of an item or a document that repeats is one, with its places.

Verbatim: a document's window with an item's template and fillings is a leak in any case. It names every item that has the window;
of more than SHARED items the least. No item's own fillings are left out, so that a copy of any of many items of one template is found.

Templates: items that differ in their fillings alone, with equal fillings at the same places, are one template, named after the least item;
a document fits all of them or none. A template matches a document where the placeholders' fillings are consistent: one filling of the
item always stands for one filling of the document and the other way round, over all windows that lie on one alignment (a window that
repeats in an item is placed where it stands first). So a question with other numbers or names is caught, and one that mixes its slots
is not. A window that more than SHARED templates hold, such as a common preamble with a name in it, is judged alone, once for each way
in which its fillings can be equal or not, and named after the least item of that way. So a window of a document meets at most
SHARED items, SHARED templates and some fifty ways to fill it, and no product of items, documents or places arises.

Defined cases: windows with fewer than five plain words, and so all items of fewer than five words, are found word for word only,
wherever these words stand; items of marks alone are not searched for; null and empty texts match nothing; null ids are carried along;
items of one text are one item, named after the least id; rows that repeat an id and its text give what one row gives, those with other
texts stand for themselves, in both tables; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import checkpointed, released, row_key

WINDOW, LEAST, SHARED = 10, 5, 16
#: Distinct hashes of benchmark windows up to this number (8 bytes each) are sent to all tasks as a filter; beyond it all windows are shuffled.
MOST_SENT = 1_000_000
#: Bytes of benchmark windows up to which they are joined by broadcast; beyond it they are shuffled.
MOST_BYTES = 64 << 20
#: Bytes of text whose words a task holds at a time; a longer text is held alone.
PIECE = 2 << 20
#: Unit words.
UNITS = frozenset("% ° mm cm m km in ft mi mg g kg t lb oz ml l s sec min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year miles mile meters meter dollars dollar euros euro cents cent percent degrees degree".split())
#: Number words.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half "
    "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille "
    "uno dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil".split()
)
_GLUED = re.compile(r"([^\w]*[-+]?[0-9][0-9.,:/]*)([^\W\d_]+|°)([^\w]*)$")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"[-+]?[0-9][0-9.,:/]*$")
_STRIP = "\"'`´.,;:!?()[]{}<>$€£%#*&|~_-–—…«»“”„¿¡"
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
SCHEMA = "id long, row long, length int, h long, slots array<string>, places array<int>, whole long"


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"))


def pieces(word: str) -> tuple[str, ...]:
    """A word, or its number and its unit where they are glued."""
    m = _GLUED.match(word)
    return (m[1], m[2] + m[3]) if m and m[2].lower() in UNITS else (word,)


def is_number(bare: str, low: str) -> bool:
    """Whether a stripped word, low in lower case, is a number in digits or words."""
    if bare.isalpha():
        return low in NUMBERS
    return bool(_NUMBER.match(bare)) or "-" in low and all(x in NUMBERS for x in low.split("-"))


def templates(texts: list[str | None]) -> dict:
    """Template hashes of all words of some texts, and what is needed to fill slots."""
    split = [(x or "").split() for x in texts]
    n = np.array([len(x) for x in split], np.int64)
    flat = np.array([w for x in split for w in x], object)
    codes, unique = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), flat)
    parts = [(w,) if w.isalpha() or not _DIGIT.search(w) else pieces(w) for w in unique]
    if max(map(len, parts), default=1) > 1:
        size = np.array([len(x) for x in parts])
        doc = np.repeat(np.arange(len(n)), n)
        n = np.bincount(np.repeat(doc, size[codes]), minlength=len(n))
        first, size = (np.cumsum(size) - size)[codes], size[codes]
        codes = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        unique = [w for x in parts for w in x]
    bare = [w.strip(_STRIP) for w in unique]
    low = [b.lower() for b in bare]
    number = np.array([is_number(b, x) for b, x in zip(bare, low, strict=True)], bool)
    unit = np.array([x in UNITS or w in ("%", "°") for x, w in zip(low, unique, strict=True)], bool)
    capital = np.array([b[:1].isupper() for b in bare], bool)
    ends = np.array([w.rstrip("\"')»”")[-1:] in ".!?" and w[-1:] != "" for w in unique], bool)
    plain = np.array([_hash(x) for x in low], np.uint64)
    if not len(codes):
        return {"n": n, "kind": np.zeros(0, np.int8), "h": np.zeros(0, np.uint64), "plain": np.zeros(0, np.uint64), "bare": bare, "codes": codes}
    first = np.zeros(len(codes), bool)
    first[np.concatenate(([0], np.cumsum(n)[:-1]))[n > 0]] = True
    before = np.concatenate(([True], ends[codes][:-1])) | first
    after_number = np.concatenate(([False], number[codes][:-1])) & ~first
    kind = np.select([number[codes], unit[codes] & after_number, capital[codes] & ~before], [1, 2, 3], 0).astype(np.int8)
    h = np.where(kind == 0, plain[codes], np.array([0, 11, 22, 33], np.uint64)[kind])
    return {"n": n, "kind": kind, "h": h, "plain": plain[codes], "bare": bare, "codes": codes}


def windows(t: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in it, hash, words taken as they are) of all windows of a length.

    Whether a window's first word is a name or a unit depends on the word before it, which a copy need not share; such a
    window is also given with this word as it is (1 in the last array). Windows that have too few plain words even so are
    given with all words as they are.
    """
    n, total = t["n"], len(t["h"])
    if total < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = total - length + 1
    doc = np.repeat(np.arange(len(n)), n)
    slots = np.concatenate(([0], np.cumsum(t["kind"] > 0)))
    plain = length - (slots[length : length + m] - slots[:m])
    inside, free = doc[:m] == doc[length - 1 :], t["kind"][:m] > 1
    ok = np.flatnonzero(inside & (plain >= LEAST))
    twice = np.flatnonzero(inside & free & (plain + 1 >= LEAST))
    bare = np.flatnonzero(inside & (plain + free < LEAST))
    h = np.zeros(0, np.uint64)
    if len(ok) or len(twice):
        every = np.full(m, length, np.uint64)
        for k in range(length):
            every *= _P
            every += t["h"][k : k + m]
        top = np.uint64(pow(int(_P), length - 1, 1 << 64))
        h = np.concatenate((every[ok], every[twice] + (t["plain"][twice] - t["h"][twice]) * top))
    exact = np.full(len(bare), length, np.uint64)
    for k in range(length):
        exact *= _P
        exact += t["plain"][bare + k]
    h = np.concatenate((h, exact))
    h ^= h >> np.uint64(29)
    at, own = np.concatenate((ok, twice, bare)), np.repeat([0, 1, length], [len(ok), len(twice), len(bare)])
    starts = np.concatenate(([0], np.cumsum(n)))
    return doc[at], at - starts[doc[at]], h, own


def _rows(t: dict, ids: list[tuple], length: int, keep=None, whole: int = 0) -> list[tuple]:
    """(id, row, length, h, slots, places, whole) of the different windows of each document."""
    doc, pos, h, own = windows(t, length)
    if keep is not None:
        chosen = np.flatnonzero(keep(h))
        doc, pos, h, own = doc[chosen], pos[chosen], h[chosen], own[chosen]
    at = np.concatenate(([0], np.cumsum(t["n"])))[doc] + pos
    found = {}
    for d, p, x, k, a in zip(doc.tolist(), pos.tolist(), h.view(np.int64).tolist(), at.tolist(), own.tolist(), strict=True):
        filled = np.flatnonzero(t["kind"][k + a : k + length])
        found.setdefault((d, x, tuple(t["bare"][t["codes"][k + a + int(s)]].lower() for s in filled)), []).append(p)
    return [(*ids[d], length, x, list(slots), places, whole) for (d, x, slots), places in found.items()]


def whole_template(t: dict) -> int:
    """A hash of an item's template and of which of its slots are filled alike."""
    at = np.flatnonzero(t["kind"])
    fillings = [t["bare"][t["codes"][k]].lower() for k in at.tolist()]
    alike = np.array([fillings.index(x) for x in fillings], np.int32)
    return xxhash.xxh3_64_intdigest(t["h"].tobytes() + alike.tobytes()) - (1 << 63)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "row", "length", "h", "slots", "places", "whole"])


def sliced(b: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Slices of about PIECE bytes of text."""
    lot = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    cuts = np.flatnonzero(np.concatenate(([True], lot[1:] != lot[:-1], [True]))) if len(lot) else np.zeros(1, np.int64)
    return [b.slice(x, y - x) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items with their length: of WINDOW words, or of the whole of a shorter item."""

    def run(batches):
        for b in batches:
            rows = []
            for i, r, x in zip(*(b.column(c).to_pylist() for c in ("id", "row", "text")), strict=True):
                t = templates([x])
                if any(t["bare"]):
                    rows += _rows(t, [(i, r)], min(WINDOW, int(t["n"][0])), whole=whole_template(t))
            yield _batch(rows)

    return benchmark.select(F.col("item_id").cast("long").alias("id"), row_key(F.col("text")).alias("row"), "text").mapInArrow(run, SCHEMA)


def document_windows(docs: DataFrame, lengths: list[int], sent: np.ndarray | None) -> DataFrame:
    """Windows of the documents, of all lengths that items' windows have; with `sent` (sorted hashes) only those found there."""
    shared = docs.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        few = shared.value
        mask = None if few is None else np.zeros(1 << 22, bool)
        if few is not None:
            mask[few >> np.uint64(42)] = True

        def keep(h):
            ok = mask[h >> np.uint64(42)]
            if len(few):
                at = np.flatnonzero(ok)
                ok[at] = few[np.minimum(np.searchsorted(few, h[at]), len(few) - 1)] == h[at]
            return ok

        for b in batches:
            for part in sliced(b):
                t, ids = templates(part.column("text").to_pylist()), list(zip(part.column("id").to_pylist(), part.column("row").to_pylist(), strict=True))
                rows = [r for length in lengths for r in _rows(t, ids, length, None if few is None else keep)]
                if rows:
                    yield _batch(rows)
        released()

    return docs.select(F.col("doc_id").cast("long").alias("id"), row_key(F.col("text")).alias("row"), "text").mapInArrow(run, SCHEMA)


def wanted(items: DataFrame, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(verbatim, templates): what a document's window can meet, by (length, h, slots) and by (length, h).

    verbatim: the items that have just this window. templates: (item_id, part, place, slots), a row a template, or, for a window that
    many templates hold, a row for each way in which its slots are filled alike, with a part of its own.
    """
    same = ["length", "h", "slots"]
    own = F.min(F.struct("id", "row")).alias("least")
    held = items.groupBy(*same).agg(F.count_distinct("row").alias("n"), own)
    few = items.join(held.filter(F.col("n") <= shared).select(*same), same, "left_semi").select(*same, F.col("id").alias("item_id"), "row")
    verbatim = few.unionByName(held.filter(F.col("n") > shared).select(*same, F.col("least.id").alias("item_id"), F.col("least.row").alias("row"))).distinct()
    least = items.groupBy("whole").agg(own)
    filled = items.filter(F.size("slots") > 0).join(least, "whole").filter(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("row") == F.col("least.row")))
    common = filled.groupBy("length", "h").agg(F.count_distinct("row").alias("n")).filter(F.col("n") > shared).select("length", "h")
    alone = filled.join(common, ["length", "h"], "left_anti").select("length", "h", F.col("id").alias("item_id"), F.col("row").alias("part"), F.col("places")[0].alias("place"), "slots")
    way = F.transform("slots", lambda x: F.array_position("slots", x).cast("int"))
    ways = filled.join(common, ["length", "h"], "left_semi").groupBy("length", "h", way.alias("way")).agg(F.min(F.struct("id", "row", F.col("places")[0].alias("place"), "slots")).alias("own"))
    ways = ways.select("length", "h", F.col("own.id").alias("item_id"), F.xxhash64("length", "h", "way").alias("part"), "own.place", "own.slots")
    return verbatim, alone.unionByName(ways)


def leaks(docs: DataFrame, benchmark: DataFrame, most_sent: int = MOST_SENT, shared: int = SHARED) -> DataFrame:
    """(doc_id, row, item_id, n_windows, reparameterised) of each document row (row is its row_key) and item: n_windows of its different windows are
    verbatim or fit the item's template; reparameterised says whether any fits with other fillings."""
    # Items of one text are one item, named after the least id.
    items = checkpointed(item_windows(benchmark).groupBy("row", "length", "h", "slots", "places", "whole").agg(F.min("id").alias("id")))
    size = items.agg(F.sum(60 + F.octet_length(F.array_join("slots", "    "))).alias("b")).first()["b"] or 0
    few = items.select("h").distinct().limit(most_sent + 1).toPandas()["h"]  # 8 bytes a window, at most most_sent + 1
    small = len(few) <= most_sent
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most WINDOW
    sent = np.sort(few.to_numpy(np.int64).view(np.uint64)) if small else None
    found = checkpointed(document_windows(docs, lengths, sent).select(F.col("id").alias("doc_id"), "row", "length", "h", "slots", "places"))
    side = F.broadcast if small and size <= MOST_BYTES else lambda x: x
    verbatim, templates = (side(checkpointed(x)) for x in wanted(items, shared))
    exact = found.join(verbatim.withColumnRenamed("row", "of"), ["length", "h", "slots"]).select("doc_id", "row", "item_id", "length", "h", "slots", F.lit(False).alias("other"))
    met = found.filter(F.size("slots") > 0).withColumnRenamed("slots", "filled").join(templates, ["length", "h"]).filter(F.size("slots") == F.size("filled"))
    met = met.select("doc_id", "row", "item_id", "part", "length", "h", "filled", F.explode("places").alias("at"), "place", F.zip_with("slots", "filled", lambda b, d: F.named_struct(F.lit("b"), b, F.lit("d"), d)).alias("fill"))
    # The different windows of one template on one alignment: never more than the item has.
    lines = met.groupBy("doc_id", "row", "item_id", "part", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.collect_set(F.struct("length", "h", F.col("filled").alias("slots"))).alias("windows"), F.array_distinct(F.flatten(F.collect_set("fill"))).alias("fill")
    )
    one = lambda k: F.size(F.array_distinct(F.transform("fill", lambda x: x[k])))
    lines = lines.filter((F.size("fill") == one("b")) & (F.size("fill") == one("d")))
    other = F.exists("fill", lambda x: x["b"] != x["d"])
    fitting = lines.select("doc_id", "row", "item_id", F.explode("windows").alias("w"), other.alias("other")).select("doc_id", "row", "item_id", "w.*", "other")
    every = exact.unionByName(fitting).groupBy("doc_id", "row", "item_id", "length", "h", "slots").agg(F.max("other").alias("other"))
    return every.groupBy("doc_id", "row", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("other").alias("reparameterised"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).drop("row")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Document rows that hold no passage of the benchmark."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("row").alias("_bad_row")).distinct()
    keyed = docs.withColumn("_dc_key", row_key(F.col("text")))
    return keyed.join(bad, keyed["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (keyed["_dc_key"] == bad["_bad_row"]), "left_anti").drop("_dc_key")
