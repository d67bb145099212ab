"""How sources of one language diverge in their use of terms, by hash-consed segment trees.

Texts are cut into terms in one pass; each task sends what it has counted a (language, source, term) once in a while, so that
frequent words cost a row a task. Terms in enough documents of a language are kept and numbered: a hash of the term gives a block of
about BLOCK terms, its rank its place there. Over a block each group (language and source) is a segment tree of its counts. Trees
are built level by level for all groups of a task, and equal nodes (a leaf is its count, an inner node the pair of its children) are
interned, so that equal subtrees, of one group or of several, are one node. Two trees are walked at the same time from their roots:
a level holds each different pair of nodes once, with the number of places where it stands, and leaf pairs are priced once. Zero
against zero, most of a rare source's tree, so costs one pair a level. Prices of blocks are added by Spark.

A task holds one block for at most about two tiles of TILE groups, whatever the number of terms and sources is: many sources are
met tile by tile. All shares are whole numbers, exact as long as a group has fewer than 9e15 tokens.

Defined cases: null text, lang and source are empty; each row is a document, also where it repeats another; a group without kept terms
has shares like any other; a language without kept terms prices its pairs at 0 and lists no terms; an empty table gives an empty
result; ties are ordered by the item's bytes; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.llm.common import checkpointed, released

#: Documents of a language that a kept term is in; what a count is smoothed by; the unit of shares; terms listed a group.
LEAST_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a block and groups of a tile: a task's matrix has some BLOCK x 2 TILE counts.
BLOCK, TILE = 4096, 64
#: Counters that a task holds before it sends them, and bytes of text that are split at a time.
HELD, PIECE = 400_000, 4 << 20
#: A-Z in lower case; everything else below 0x80 that is no letter parts terms. Bytes from 0x80 on are parts of letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, of about PIECE bytes at a time."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of terms, as tasks have counted them so far."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flushed(found):
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                columns = [pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), pa.repeat(pa.scalar(source), len(part)), *columns], schema=schema)

    def run(batches):
        found, held = defaultdict(lambda: (Counter(), Counter())), 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                n, docs = found[lang, source]
                before, seen = len(n), set()
                for words in terms_of(text.as_py()):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n) - before
                if held > HELD:
                    yield from flushed(found)
                    found.clear()
                    held = 0
        yield from flushed(found)
        released()

    empty = F.lit("")
    texts = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).alias("text"))
    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_cells(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang) of kept terms and the groups that use them; one shuffle serves all sums."""
    cells = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    known = cells.withColumns({"n_lang": F.sum("n").over(w), "docs": F.sum("docs").over(w)})
    return known.filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "n_lang")


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH terms)), by three digits to the base of 1000."""
    base = total + SMOOTH * terms
    digit, rest = np.divmod(np.asarray(count, np.int64) + SMOOTH, base)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, base)
        digit = digit * 1000 + more
    return digit + 1


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(counts of leaves, children of the nodes of each level from the leaves up, root of each row) of the rows' segment trees.

    The last leaf is void: it fills rows up to a power of two. Levels above the leaves have (left, right) of each different node.
    """
    values, ids = np.unique(counts, return_inverse=True)
    ids = ids.reshape(counts.shape)
    width = 1 << max(0, counts.shape[1] - 1).bit_length()
    ids = np.concatenate((ids, np.full((len(counts), width - counts.shape[1]), len(values))), axis=1)
    levels, n = [], len(values) + 1
    while ids.shape[1] > 1:
        pairs, ids = np.unique(ids[:, 0::2] * n + ids[:, 1::2], return_inverse=True)
        ids = ids.reshape(len(counts), -1)
        levels.append((pairs // n, pairs % n))
        n = len(pairs)
    return values, levels, ids[:, 0]


def met(g: int, others: np.ndarray, levels: list, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(other, leaf of g, leaf of the other, places) for every different pair of leaves that the walk of g's tree with each other's meets."""
    who, a, b, places = np.arange(len(others)), np.full(len(others), roots[g]), roots[others], np.ones(len(others), np.int64)
    for left, right in reversed(levels):
        who = np.concatenate((who, who))
        a, b, places = np.concatenate((left[a], right[a])), np.concatenate((left[b], right[b])), np.concatenate((places, places))
        order = np.lexsort((b, a, who))
        who, a, b, places = who[order], a[order], b[order], places[order]
        new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        who, a, b, places = who[new], a[new], b[new], np.add.reduceat(places, new)
    return who, a, b, places


def apart(counts: np.ndarray, totals: list[int], terms: int, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(g, h, sum of |p - q| over the columns) for the pairs g < h of rows that are wanted (a matrix of booleans)."""
    values, levels, roots = consed(counts)
    price = [np.concatenate((shares(values, t, terms), [0])) for t in totals]  # the void leaf costs nothing
    for g in range(len(counts)):
        others = np.flatnonzero(wanted[g])
        others = others[others > g]
        if not len(others):
            continue
        who, a, b, places = met(g, others, levels, roots)
        theirs = np.concatenate([price[others[k]][b[who == k]] for k in range(len(others))])  # who ascends
        sums = np.zeros(len(others), np.int64)
        np.add.at(sums, who, np.abs(price[g][a] - theirs) * places)
        yield from zip([g] * len(others), others.tolist(), sums.tolist(), strict=True)


def audited(part: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """Rows (lang, source, part, item, value) of one block and one pair of tiles: pairs priced over the block, and its first terms a group.

    Rows without term name the groups (n: tokens of the group, n_lang: of the language, terms: kept ones of it), those without source the block's terms.
    """
    groups = part[part["term"].isna()].sort_values("source", key=lambda s: s.str.encode("utf-8"))
    if groups.empty:  # tiles that no source falls into
        return pd.DataFrame(columns=["lang", "source", "part", "item", "value"])
    terms = part[part["source"].isna()].sort_values("term")
    cells = part[part["source"].notna() & part["term"].notna()]
    lang, source = groups["lang"].iloc[0], groups["source"].tolist()
    of_group, of_term = {s: k for k, s in enumerate(source)}, {t: k for k, t in enumerate(terms["term"])}
    counts = np.zeros((len(source), len(terms)), np.int64)
    counts[cells["source"].map(of_group).to_numpy(np.int64), cells["term"].map(of_term).to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    totals, kept = [int(x) for x in groups["n"]], int(groups["terms"].iloc[0])
    tile = groups["tile"].to_numpy()
    ta, tb = part["ta"].iloc[0], part["tb"].iloc[0]
    across = tile[:, None] != tile[None, :] if ta != tb else np.ones((len(tile), len(tile)), bool)
    if len(terms):
        sums = list(apart(counts, totals, kept, across))
    else:
        sums = [(g, h, 0) for g in range(len(source)) for h in range(g + 1, len(source)) if across[g, h]]
    rows = [(lang, source[x], "pair", source[y], v) for g, h, v in sums for x, y in ((g, h), (h, g))]
    if ta == tb and len(terms):
        q = shares(terms["n"].to_numpy(np.int64), int(groups["n_lang"].iloc[0]), kept)
        name = terms["term"].tolist()
        place = np.argsort(np.argsort(np.array([t.encode() for t in name], object)))
        for g, s in enumerate(source):
            more = shares(counts[g], totals[g], kept) - q
            used = np.flatnonzero((counts[g] > 0) & (more > 0))
            first = used[np.lexsort((place[used], -more[used]))][:top]
            rows += [(lang, s, "term", name[k], v) for k, v in zip(first.tolist(), more[first].tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the `top` terms that the source uses more than the language."""
    empty = F.lit("")
    cells = checkpointed(kept_cells(docs, least_docs))
    terms = cells.groupBy("lang", "term").agg(F.first("n_lang").alias("n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("n_lang"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(langs, "lang", "left").fillna(0, ["terms", "n_lang"])
    # A row a language: in how many blocks and tiles it is cut.
    plan = checkpointed(sizes.withColumns({"blocks": F.greatest(F.ceil(F.col("terms") / block), F.lit(1)).cast("int"), "tiles": F.ceil(F.col("groups") / tile).cast("int")}))
    known = groups.join(sums, ["lang", "source"], "left").fillna(0, ["n"]).join(plan, "lang")

    of_block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    of_tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    mine = F.explode(F.transform(every, lambda x: F.struct(F.least(x, "tile").alias("ta"), F.greatest(x, "tile").alias("tb"))))
    pairs = F.explode(F.flatten(F.transform(every, lambda a: F.transform(F.sequence(a, F.col("tiles") - 1), lambda b: F.struct(a.alias("ta"), b.alias("tb"))))))
    null = lambda t: F.lit(None).cast(t)
    columns = ["lang", "block", "p.ta", "p.tb", "source", "term", "tile", "n", "n_lang", "terms"]
    used = cells.select("lang", "source", "term", "n").join(plan.select("lang", "blocks", "tiles"), "lang").withColumns({"block": of_block, "tile": of_tile, "n_lang": null("long"), "terms": null("long")})
    named = known.withColumns({"tile": of_tile, "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "term": null("string")})
    listed = terms.join(plan.select("lang", "blocks", "tiles"), "lang").withColumns({"block": of_block, "source": null("string"), "tile": null("int"), "n_lang": null("long"), "terms": null("long")})
    rows = used.withColumn("p", mine).select(*columns).unionByName(named.withColumn("p", mine).select(*columns)).unionByName(listed.withColumn("p", pairs).select(*columns))
    found = rows.groupBy("lang", "block", "ta", "tb").applyInPandas(lambda x: audited(x, top), "lang string, source string, part string, item string, value long")
    found = checkpointed(found)
    priced = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = priced.unionByName(found.filter("part = 'term'")).withColumn("rank", F.row_number().over(w))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def digest(docs: DataFrame) -> DataFrame:
    return audit(docs)


#: DuckDB SQL for digest().
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (s.total + {SMOOTH} * v.v)::HUGEINT AS p
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + ({UNIT}::HUGEINT * (k.n + {SMOOTH})) // (v.total + {SMOOTH} * v.v)::HUGEINT AS q FROM k JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
