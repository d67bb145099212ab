"""Exact similarity join of documents on five-word shingles, by metric space partitioning.

Jaccard distance is a metric. Two documents link at distance 1/4 or less. Nearly all pairs of documents lie at distance 1, so
that pivots drawn from the whole corpus would leave everything in one region; regions are therefore opened where distances are
informative, and pivots, Voronoi cells and triangle-inequality windows work inside them:

1. How many documents hold each shingle is counted over all (packed exchange of hashes). A document with more than a quarter of
   its shingles to itself links with nothing. Documents with equal sets become one node.
2. A node opens regions at its rarest shingles, so many that two linked nodes must share one (the first n - ceil(3n/4) + 1 in the
   order of frequency). In each region the least node is the first pivot; nodes within 1/4 of a pivot link with it, and such
   linked nodes need not be compared with each other, as only connection counts.
3. Families of nodes, tied by regions in common, that still hold more than one component are joined exactly by pivots: each node
   belongs to its nearest pivot's cell and is replicated into a later cell where d(x, q) - d(x, p) <= 2/4 and d(x, q) <= the
   cell's radius + 1/4; cells join recursively. Families of more than REGION nodes are cut into cells by Spark, a round of joins
   and shuffles a level (`cut_into_cells`); smaller ones, and cells, in a task, with eight pivots far from each other. What does
   not get smaller by cells, as its members are about equally far from all pivots, is taken apart by its openings and compared in
   blocks.
4. Connected components over all links.

Memory is bounded: regions of more than REGION nodes are cut into pairs of blocks of REGION / 2, each pair a region of its own.
No pairs of copies or of linked nodes are ever written.

Defined cases: null and empty texts have the empty set and link with nothing; fewer than five words are one shingle; rows with
equal sets are one node, whatever their ids; rows that repeat a doc_id with another text stand for themselves, each in its own
component, named after the least doc_id there; a null doc_id never is a component's id beside others; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm import exchange
from tracework.llm.common import checkpointed, row_key
from tracework.llm.components import components
from tracework.llm.exchange import releasing, table_of, unpack

SHINGLE = 5
REGION, LEAF, PIVOTS = 8000, 48, 8
RADIUS = 0.25
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII capitals are folded."""
    split = [x.lower().split() for x in data]  # bytes: ASCII alone
    n = np.array([len(x) for x in split], np.int64)
    flat = np.empty(int(n.sum()), object)
    flat[:] = [w for x in split for w in x]
    if not len(flat):
        return [np.zeros(0, np.uint64)] * len(data)
    codes, words = pd.factorize(flat)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[codes]
    m = max(0, len(h) - SHINGLE + 1)
    s = np.full(m, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        s *= _P
        s += h[k : k + m]
        s ^= s >> np.uint64(29)
    s *= _P
    s ^= s >> np.uint64(32)
    at = np.concatenate(([0], np.cumsum(n)))
    out = []
    for i, k in enumerate(n.tolist()):
        if k >= SHINGLE:
            out.append(np.unique(s[at[i] : at[i + 1] - SHINGLE + 1]))
        elif k:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(split[i]), seed=k)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, node, shingles, openings) per document, row being its row_key; the last three only where a link is possible."""
    batches, buckets, bits = exchange.plan(docs)
    dealt = exchange.batched(docs, batches)
    shift = np.uint64(64 - bits)
    sent_schema = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("counts", pa.binary())])

    def counted(sets):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return np.unique(flat >> shift, return_inverse=True, return_counts=True)

    def send(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        h, _, n = counted(shingle_sets(exchange.in_order(table)[1]))
        return table_of([(batch, *x) for x in exchange.sent(h, bits, buckets, np.minimum(n, 255).astype(np.uint8))], sent_schema)

    replies = exchange.answers(dealt.groupBy("batch").applyInArrow(releasing(send), "batch int, bucket int, payload binary, counts binary"))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("node", pa.string()), ("shingles", pa.list_(pa.int64())), ("openings", pa.list_(pa.int64()))])

    def open_regions(left: pa.Table, right: pa.Table) -> pa.Table:
        _, data, names = exchange.in_order(left)
        sets = shingle_sets(data)
        _, inverse, _ = counted(sets)
        got = sorted((r["bucket"], r["reply"]) for r in right.to_pylist())
        often = np.concatenate([unpack(x, np.uint8) for _, x in got] or [np.zeros(0, np.uint8)])[inverse]
        rows, at = [], 0
        for name, row, s in zip(names, exchange.rows_in_order(left), sets, strict=True):
            f = often[at : at + len(s)]
            at += len(s)
            n, alone = len(s), int((f == 1).sum())
            if not n or 4 * alone > n:
                rows.append((name, row, n, None, None, None))
                continue
            first = np.lexsort((s, f))[alone : n - -(-3 * n // 4) + 1]
            rows.append((name, row, n, hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), s.view(np.int64), s[first].view(np.int64)))
        return table_of(rows, schema)

    return dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(releasing(open_regions), "doc_id long, row long, n long, node string, shingles array<long>, openings array<long>")


def near(n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements with `both` in common link, in whole numbers."""
    return 100 * both >= 75 * (n + m - both)


class Part:
    """Some members of a region with their sets laid end to end, so that one set meets all others in a few array steps."""

    def __init__(self, members: np.ndarray, sets: list[np.ndarray], width: int):
        self.members = members
        self.n = np.array([len(sets[i]) for i in members], np.int64)
        self.flat = np.concatenate([sets[i] for i in members])
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.mark = np.zeros(width, bool)

    def common_with(self, k: int) -> np.ndarray:
        """Sizes of the intersections of member k's set with every member's."""
        own = self.flat[self.at[k] : self.at[k + 1]]
        self.mark[own] = True
        hits = np.add.reduceat(self.mark[self.flat].astype(np.int32), self.at[:-1])
        self.mark[own] = False
        return hits


def region_links(sets: list[np.ndarray], labels: list, leaf: int = LEAF, pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """Links between members of a region that connect all that is connected, beyond what equal labels say."""
    _, component = np.unique(np.asarray(labels, object).astype(str), return_inverse=True)
    links: list[tuple[int, int]] = []
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
    known, ids = np.unique(flat, return_inverse=True)
    sets = np.split(ids, np.cumsum(n)[:-1])

    def link(part: Part, k: int, both: np.ndarray) -> None:
        """Join member k with those of other components that it links with, one of each component."""
        i = part.members[k]
        for j in part.members[near(part.n[k], part.n, both) & (component[part.members] != component[i])].tolist():
            if component[i] != component[j]:
                component[component == component[j]] = component[i]
                links.append((int(i), j))

    def exactly(part: Part) -> None:
        """All pairs of different components: each member outside the largest component meets every other."""
        kinds, sizes = np.unique(component[part.members], return_counts=True)
        for k in np.flatnonzero(component[part.members] != kinds[sizes.argmax()]).tolist():
            link(part, k, part.common_with(k))

    def split(members: np.ndarray) -> None:
        if len(np.unique(component[members])) < 2:
            return
        part = Part(members, sets, len(known))
        if len(members) <= leaf:
            exactly(part)
            return
        chosen, distance = [0], []
        while True:
            k = chosen[-1]
            both = part.common_with(k)
            distance.append(1 - both / (part.n + part.n[k] - both))
            link(part, k, both)
            far = np.min(distance, axis=0)
            if len(chosen) == pivots or far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        d = np.stack(distance)
        cell = d.argmin(0)
        own = d[cell, np.arange(len(members))]
        cells = []
        for q in range(len(chosen)):
            mine = cell == q
            if mine.any():
                window = (cell < q) & (d[q] - own <= 2 * RADIUS + 1e-9) & (d[q] <= d[q][mine].max() + RADIUS + 1e-9)
                cells.append(mine | window)
        if max(x.sum() for x in cells) > 0.7 * len(members):  # distances do not tell these apart
            exactly(part)
            return
        del part, d, distance
        for x in cells:
            split(members[x])

    split(np.arange(len(sets)))
    return links


def cut_into_cells(members: DataFrame, sets: DataFrame, region: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, stubborn, links) of large families: members (g, node, label), sets (node, n, shingles).

    Each round takes PIVOTS nodes of each group that is still too large, by hash, gives every node to its nearest pivot's cell and
    copies it into the later cells that the triangle inequality does not rule out. Groups of one component are done; a group of
    which one cell keeps more than seven tenths is stubborn. The number of pivots is PIVOTS for each `region` nodes at most.
    """
    cells, stubborn, links = None, None, None
    add = lambda x, y: y if x is None else x.unionByName(y)
    live = checkpointed(members.withColumn("was", F.lit(None).cast("long")))
    for level in itertools.count():
        sizes = checkpointed(live.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y"), F.max("was").alias("was")).filter("x != y").drop("x", "y"))
        rows = live.join(sizes.select("g", "size", F.col("was").alias("before")), "g")
        stuck = F.col("size") > 0.7 * F.coalesce(F.col("before").cast("double"), F.lit(float("inf")))
        cells = add(cells, rows.filter(F.col("size") <= region).select("g", "node", "label"))
        stubborn = add(stubborn, rows.filter((F.col("size") > region) & stuck).select("g", "node", "label"))
        large = checkpointed(rows.filter((F.col("size") > region) & ~stuck).select("g", "node", "label", "size"))
        if large.isEmpty():
            return cells, stubborn, links
        h = F.xxhash64("node", F.lit(level))
        chosen = large.groupBy("g", F.pmod(h, F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct(h.alias("h"), F.col("node").alias("node")))["node"].alias("pivot"))
        chosen = checkpointed(chosen.join(sets.select(F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("shingles").alias("ps")), "pivot"))
        met = large.join(chosen.select("g", "k", "pivot"), "g").join(sets, "node").join(chosen.select("g", "k", "pn", "ps"), ["g", "k"])
        both = F.size(F.array_intersect("shingles", "ps"))
        far = checkpointed(met.withColumn("both", both).select("g", "node", "label", "size", "k", "pivot", (1 - F.col("both") / (F.col("n") + F.col("pn") - F.col("both"))).alias("d"), (100 * F.col("both") >= 75 * (F.col("n") + F.col("pn") - F.col("both"))).alias("near")))
        links = add(links, far.filter("near AND node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        own = far.groupBy("g", "node", "label", "size").agg(F.min(F.struct("d", "k")).alias("own"), F.collect_list(F.struct("k", "d")).alias("all"))  # PIVOTS at most
        own = checkpointed(own)
        radius = own.groupBy("g", F.col("own.k").alias("k")).agg(F.max("own.d").alias("radius"))
        each = own.select("g", "node", "label", "size", "own", F.explode("all").alias("q")).select("g", "node", "label", "size", F.col("own.k").alias("home"), F.col("own.d").alias("at"), "q.k", "q.d")
        window = (F.col("home") < F.col("k")) & (F.col("d") - F.col("at") <= 2 * RADIUS + 1e-9) & (F.col("d") <= F.col("radius") + RADIUS + 1e-9)
        placed_ = each.join(radius, ["g", "k"]).filter((F.col("home") == F.col("k")) | window)
        live = checkpointed(placed_.select(F.concat_ws("/", "g", F.col("k").cast("string")).alias("g"), "node", "label", F.col("size").alias("was")))


def links_of(known: DataFrame, region: int = REGION) -> DataFrame:
    """(a, b): links that connect all nodes (node, n, shingles, openings) which are connected by similarity."""
    opened = checkpointed(known.select("node", "n", F.explode("openings").alias("s")))
    shared = opened.groupBy("s").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot != other").select("s", "pivot")
    member = checkpointed(opened.select("node", "s").join(shared, "s"))
    met = checkpointed(member.filter("node != pivot").select("node", "pivot").distinct())
    sized = known.select("node", "n", "shingles")
    pairs = met.join(known.select("node", "n"), "node").join(known.select(F.col("node").alias("pivot"), F.col("n").alias("pn")), "pivot").filter("4 * least(n, pn) >= 3 * greatest(n, pn)")
    tried = pairs.join(sized.select(F.col("node").alias("pivot"), F.col("shingles").alias("ps")), "pivot").join(sized.select("node", F.col("shingles").alias("ns")), "node")
    both = F.size(F.array_intersect("ns", "ps"))
    stars = checkpointed(tried.withColumn("both", both).filter(100 * F.col("both") >= 75 * (F.col("n") + F.col("pn") - F.col("both"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    labels = components(stars)
    # A family: nodes tied by regions in common. Each with more than one component is one region, unless it is too large.
    family = components(met.select(F.col("node").alias("a"), F.col("pivot").alias("b"))).withColumnRenamed("label", "family")
    marked = checkpointed(family.join(labels, "node", "left").select("node", "family", F.coalesce("label", "node").alias("label")))
    open_ = marked.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("family", "size")
    rows = marked.join(open_, "family")
    small = rows.filter(F.col("size") <= region).select(F.col("family").alias("g"), "node", "label")
    large, found = checkpointed(rows.filter(F.col("size") > region).select(F.col("family").alias("g"), "node", "label")), stars
    if not large.isEmpty():
        cells, large, more = cut_into_cells(large, sized, region)
        small, found = small.unionByName(cells), found if more is None else found.unionByName(more)
    small = small.select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "label")
    # Of what stays large each opening is a region; of those with the same members one is enough.
    large = member.join(large.select("node", "label").distinct(), "node")
    mixed = large.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("h"), F.sum(F.xxhash64(F.lit("~"), "node").cast("decimal(38,0)")).alias("t"))
    mixed = mixed.filter("x != y").groupBy("size", "h", "t").agg(F.min("s").alias("s"))
    large = large.join(mixed.select("s", "size"), "s")
    # Blocks of half a region; each pair of blocks meets in a region of its own.
    blocks = F.when(F.col("size") <= region, 1).otherwise(F.ceil(F.col("size") * 2 / region)).cast("int")
    large = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    large = large.select(F.col("s").cast("string").alias("g"), "node", "label", F.explode(meets).alias("pair")).select("g", "pair.i", "pair.j", "node", "label")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        names = pdf["node"].tolist()
        found = region_links([np.asarray(x, np.int64) for x in pdf["shingles"]], pdf["label"].tolist())
        return pd.DataFrame({"a": [names[i] for i, _ in found], "b": [names[j] for _, j in found]}, dtype=object)

    more = small.unionByName(large).join(known.select("node", "shingles"), "node").groupBy("g", "i", "j").applyInPandas(releasing(join), "a string, b string")
    return found.unionByName(more)


def placed(docs: DataFrame, region: int = REGION) -> DataFrame:
    """(doc_id, row, n_shingles, label) per document: equal labels are one component, null ones link with nothing."""
    found = checkpointed(nodes(docs))
    known = found.filter("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("openings").alias("openings"))
    known = checkpointed(known)
    labels = components(links_of(known, region))
    return found.select("doc_id", "row", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")


def joined(docs: DataFrame, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    places = placed(docs, region)
    # Written, so that the join has an exchange of its own on either side and a hot label is split.
    least = checkpointed(places.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least")))
    return places.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    return joined(docs)


def stage(docs: DataFrame) -> DataFrame:
    """One document row of each component: that with the least doc_id, nulls last, and of its texts that with the least row_key."""
    places = placed(docs.select("doc_id", "text")).filter("label IS NOT NULL")
    own = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    least = checkpointed(places.groupBy("label").agg(F.min(own).alias("least")))
    drop = places.join(least, "label").filter(own != F.col("least")).select(F.col("doc_id").alias("_gone"), F.col("row").alias("_gone_row")).distinct()
    keyed = docs.withColumn("_jj_key", row_key(F.col("text")))
    kept = keyed.join(drop, keyed["doc_id"].eqNullSafe(drop["_gone"]) & (keyed["_jj_key"] == drop["_gone_row"]), "left_anti")
    return kept.drop("_jj_key").dropDuplicates(["doc_id", "text"])
