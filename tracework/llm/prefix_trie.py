"""Prefix trie of conversations by truncation peeling.

A turn is known by an MD5 of role and text, a prefix of d turns (a node) by an MD5 chain over them; the chain of a conversation, its
path, is what travels instead of texts. Equal paths are one row, with their number, least id and the SHA-256 of their ids, fed in
order from blocks of ids. Paths are sorted over Spark's ranges, so that a node is a run of rows.

A task peels its range from the greatest depth down: conversations that end at a depth join the nodes that survived from below,
equal nodes are merged, what is known of them is final (members, children, leaves, saved bytes), and each loses its last turn and is
regrouped one level up, where its parent's least id is found. So every node is discovered and aggregated once. A node that
holds a range's first or last row may go on in the neighbouring range: such nodes lie on two paths a range, and these paths, with what
is known along them so far, are the rows of the next round, which peels them in the same way, over fewer ranges, until one is left.

Defined cases: rows without conv_id belong to no conversation; null role and text are empty; a null turn comes first; turns with
one number are ordered by the MD5 of role and text, and repeated rows are turns of their own; empty texts cost nothing; an empty
table has no node, not even a root; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.llm.common import checkpointed, released

#: Bytes of a node's key; ids whose digits are joined at a time; bytes of paths that a task peels.
KEY, BLOCK, RANGE_BYTES = 16, 4096, 32 << 20
#: Parents on ranges' borders up to this number (24 bytes each) are sent to all tasks; beyond it they are shuffled.
MOST_SENT = 200_000
EVENTS = "array<struct<depth: int, n: long, conv: long, sha: string, kids: long, leaves: long, saved: long>>"
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
CHAIN = f"path binary, sizes array<int>, events {EVENTS}"
_EVENTS = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("conv", pa.int64()), ("sha", pa.string()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]))
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int32()), *[(c, pa.int64()) for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]]
    + [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("path", pa.binary()), ("sizes", pa.list_(pa.int32())), ("events", _EVENTS)]
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame, family: int = 1, most_shared: int = 0) -> DataFrame:
    """(conv_id, path, sizes) of each conversation: the keys of its nodes below the root, and the bytes of each turn's text.

    With a family of f ids, conversation c starts with the first h turns of conversation c - c % f, and has its own turns after its
    first h; h is the CRC-32 of c's decimal digits modulo most_shared + 1.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    head = F.col("conv_id") - F.col("conv_id") % family
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(head.alias("head"), F.col("conv_id").cast("long").alias("conv_id"), "turn", turn.alias("h"), F.octet_length(text).alias("size"))

    def made(head, own):
        for c, (turns, sizes) in own.items():
            if family > 1:
                h = zlib.crc32(str(c).encode()) % (most_shared + 1)
                first, bytes_of = own.get(head, ([], []))
                turns, sizes = first[:h] + turns[h:], bytes_of[:h] + sizes[h:]
            key, chain = b"", []
            for t in turns:
                key = hashlib.md5(key + t).digest()
                chain.append(key)
            yield c, b"".join(chain), sizes

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["conv_id", "path", "sizes"])

    def run(batches):
        at, own, out, held = None, {}, [], 0
        for b in batches:
            for head, c, t, size in zip(*(b.column(x).to_pylist() for x in ("head", "conv_id", "h", "size")), strict=True):
                if head != at:
                    out += made(at, own)
                    at, own = head, {}
                turns, sizes = own.setdefault(c, ([], []))
                turns.append(t)
                sizes.append(size)
                held += KEY
            if held > 4 << 20 and out:
                yield batch(out)
                out, held = [], 0
        out += made(at, own)
        if out:
            yield batch(out)
        released()

    return rows.repartition("head").sortWithinPartitions("head", "conv_id", "turn", "h").mapInArrow(run, "conv_id long, path binary, sizes array<int>")


def blocks(found: DataFrame) -> DataFrame:
    """(path, block, n, conv, ids, sizes): the conversations of one path whose ids lie in one block, a row however many there are."""
    ids = F.sort_array(F.collect_list("conv_id"))
    made = found.groupBy("path", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids"), F.first("sizes").alias("sizes"))
    return made.select("path", "block", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("conv"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "sizes")


class Run:
    """Rows of a range in order: paths with their turns' bytes, and what is known at some depths of them (events)."""

    def __init__(self):
        self.paths, self.sizes, self.at, self.events = [], [], [], []

    def add(self, path: bytes, sizes: list[int], events: list[tuple]) -> None:
        self.events += events
        self.at += [len(self.paths)] * len(events)
        self.paths.append(path)
        self.sizes.append(sizes)


def ended(batches: Iterator[pa.RecordBatch]) -> Run:
    """Rows of blocks(), in order of path and block, as a run: one event a path, at its end."""
    run, last, n, conv, sha, sizes = Run(), None, 0, 0, None, None

    def close():
        if last is not None:
            run.add(last, sizes, [(len(last) // KEY, n, conv, sha.hexdigest(), 0, 0, 0)])

    for b in batches:
        for path, k, c, ids, s in zip(*(b.column(x).to_pylist() for x in ("path", "n", "conv", "ids", "sizes")), strict=True):
            if path == last:
                n, conv = n + k, min(conv, c)
                sha.update(b"," + ids.encode())
            else:
                close()
                last, n, conv, sizes, sha = path, k, c, s, hashlib.sha256(ids.encode())
    close()
    return run


def chained(batches: Iterator[pa.RecordBatch]) -> Run:
    """Paths on ranges' borders, in order, as a run."""
    run = Run()
    for b in batches:
        for path, sizes, events in zip(*(b.column(x).to_pylist() for x in ("path", "sizes", "events")), strict=True):
            run.add(path, sizes, [tuple(e[x] for x in ("depth", "n", "conv", "sha", "kids", "leaves", "saved")) for e in events])
    return run


def peeled(run: Run, whole: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    """The nodes of a run from the greatest depth down, and, unless the run is the whole table, its two border paths.

    keyed: whether nodes are given with their key, for those of earlier rounds that wait for their parent.
    """
    if not run.paths:
        return
    length = np.array([len(p) // KEY for p in run.paths])
    off = np.concatenate(([0], np.cumsum(length)))
    keys = np.frombuffer(b"".join(run.paths), f"V{KEY}")
    sizes = np.array([x for s in run.sizes for x in s], np.int64)
    row = np.array(run.at, np.int64)
    depth, n, conv, kids, leaves, saved = (np.array([e[k] for e in run.events], np.int64) for k in (0, 1, 2, 4, 5, 6))
    sha = np.array([k if e[3] is not None else -1 for k, e in enumerate(run.events)], np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    last = len(length) - 1
    kept, parents, waiting, border = [], [], [], ([], [])
    made = 0
    none = np.zeros(0, np.int64)
    up = {"row": none, "n": none, "conv": none, "leaves": none, "saved": none, "node": none}  # survivors, a row each
    for d in range(int(depth.max()), -1, -1):
        new = order[cuts[d] : cuts[d + 1]]
        ones = np.ones(len(up["row"]), np.int64)
        rows = np.concatenate((row[new], up["row"]))
        if not len(rows):
            continue
        o = np.argsort(rows, kind="stable")
        rows = rows[o]
        own = keys[off[rows] + d - 1] if d else None
        start = np.concatenate(([True], own[1:] != own[:-1])) if d else np.arange(len(rows)) == 0
        at = np.flatnonzero(start)
        add = lambda a, b: np.add.reduceat(np.concatenate((a[new], b))[o], at)  # noqa: E731, B023
        g = {"n": add(n, up["n"]), "kids": add(kids, ones), "leaves": add(leaves, up["leaves"]), "saved": add(saved, up["saved"])}
        g["conv"] = np.minimum.reduceat(np.concatenate((conv[new], up["conv"]))[o], at)
        g["sha"] = np.maximum.reduceat(np.concatenate((sha[new], 0 * ones - 1))[o], at)
        first = rows[at]
        if whole:
            side = np.full(len(at), -1)
        elif d:  # on the path of the first row, of the last row, or on neither
            holds = [own[at] == keys[off[r] + d - 1] if length[r] >= d else np.zeros(len(at), bool) for r in (0, last)]
            side = np.select(holds, [0, 1], -1)
        else:
            side = np.zeros(1, np.int64)
        for k in np.flatnonzero(side >= 0):
            e = run.events[g["sha"][k]][3] if g["sha"][k] >= 0 else None
            border[side[k]].append((d, int(g["n"][k]), int(g["conv"][k]), e, int(g["kids"][k]), int(g["leaves"][k]), int(g["saved"][k])))
        # Nodes that came up a level learn their parent, or wait for it.
        group = np.cumsum(start) - 1
        came = np.concatenate((np.full(len(new), -1), up["node"]))[o]
        child = came >= 0
        known = side[group] < 0
        parents.append((came[child & known], g["conv"][group[child & known]]))
        late = child & ~known
        if late.any():
            waiting.append((came[late], own[late] if d else np.full(int(late.sum()), None)))
        done = side < 0
        g = {k: v[done] for k, v in g.items()} | {"row": first[done]}
        g["leaves"] = np.where(g["kids"] == 0, 1, g["leaves"])
        if d:
            g["saved"] = g["saved"] + (g["n"] - 1) * sizes[off[g["row"]] + d - 1]
        g["node"] = made + np.arange(len(g["row"]))
        made += len(g["row"])
        kept.append((np.full(len(g["row"]), d), g))
        up = {k: g[k] for k in up}
    yield from _nodes(run, kept, parents, waiting, made, (keys, off) if keyed else None)
    chains = [(run.paths[r], run.sizes[r], [dict(zip(("depth", "n", "conv", "sha", "kids", "leaves", "saved"), e, strict=True)) for e in border[k]]) for k, r in ((0, 0), (1, last)) if border[k]]
    if chains:
        blank = [pa.nulls(len(chains), f.type) for f in list(_SCHEMA)[:-3]]
        yield pa.RecordBatch.from_arrays([*blank, *[pa.array(x, f.type) for x, f in zip(zip(*chains, strict=True), list(_SCHEMA)[-3:], strict=True)]], schema=_SCHEMA)


def _nodes(run: Run, kept: list, parents: list, waiting: list, made: int, key_of, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of finished nodes."""
    col = {k: np.concatenate([g[k] for _, g in kept]) for k in ("conv", "n", "kids", "leaves", "saved", "sha", "row")}
    depth = np.concatenate([d for d, _ in kept])
    parent, has = np.zeros(made, np.int64), np.zeros(made, bool)
    for node, c in parents:
        parent[node], has[node] = c, True
    late = np.full(made, None, object)
    for node, key in waiting:
        late[node] = [b"" if x is None else x.tobytes() for x in key]
    for a in range(0, made, most):
        p = slice(a, a + most)
        key = None
        if key_of:
            keys, off = key_of
            key = [keys[off[r] + d - 1].tobytes() if d else b"" for r, d in zip(col["row"][p].tolist(), depth[p].tolist(), strict=True)]
        m = len(depth[p])
        got = [
            pa.array(col["conv"][p]), pa.array(depth[p].astype(np.int32)), pa.array(parent[p], mask=~has[p]), *[pa.array(col[c][p]) for c in ("n", "kids", "leaves", "saved")],
            pa.array([run.events[k][3] if k >= 0 else NO_ENDS for k in col["sha"][p].tolist()], pa.string()), pa.nulls(m, pa.binary()) if key is None else pa.array(key, pa.binary()), pa.array(late[p], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([*got, *[pa.nulls(m, f.type) for f in list(_SCHEMA)[-3:]]], schema=_SCHEMA)


def trie(found: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node, for paths().

    conv_id and depth name a node: the least conversation that starts with it.
    """
    rows, rest, keyed = checkpointed(blocks(found)), ["path", "block"], False
    done, late = None, None
    while True:
        size = rows.agg(F.sum(F.length("path") * 2 + 100).alias("b"), F.count(F.lit(1)).alias("n")).first()
        # Later rounds have at most two rows a range: at most an eighth as many ranges as rows, so that they come to an end.
        k = max(1, -(-(size["b"] or 0) // range_bytes))
        k = min(k, max(1, size["n"] // 8)) if keyed else k
        whole, read = k == 1, chained if keyed else ended

        def run(batches, whole=whole, read=read, keyed=keyed):
            yield from peeled(read(batches), whole, keyed)
            released()

        # One range is dealt as one partition; ranges are cut by Spark's sample of the paths.
        dealt = rows.repartition(1) if whole else rows.repartitionByRange(k, "path")
        made = checkpointed(dealt.sortWithinPartitions(*rest).mapInArrow(run, f"{NODE}, {CHAIN}"))
        nodes = made.filter("conv_id IS NOT NULL").drop("path", "sizes", "events")
        done = nodes if done is None else done.unionByName(nodes)
        late = nodes if keyed and late is None else late.unionByName(nodes) if keyed else late
        if whole:
            break
        rows, rest, keyed = made.filter("conv_id IS NULL").select("path", "sizes", "events"), ["path"], True
    names = [c.split()[0] for c in NODE.split(", ")][:-2]
    if late is None:
        return done.select(*names)
    above = late.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
    above = F.broadcast(above) if above.count() <= MOST_SENT else above
    wait = done.filter("parent_key IS NOT NULL").join(above, F.col("parent_key") == F.col("_key"))
    return done.filter("parent_key IS NULL").select(*names).unionByName(wait.withColumn("parent_conv_id", F.col("_conv")).select(*names))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of trie(paths(conversations)) with role and text of their last turn; the root's are null."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    place = F.row_number().over(Window.partitionBy("_conv").orderBy("_turn", "_h"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), turn.alias("_h"), role.alias("role"), text.alias("text")).withColumn("_depth", place)
    return nodes.join(turns, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") == F.col("_depth")), "left").drop("_conv", "_turn", "_h", "_depth")


def digest(conversations: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    got = trie(paths(conversations, family=5, most_shared=8), range_bytes)
    return got.withColumn("depth", F.col("depth").cast("long"))


#: DuckDB SQL for digest(): all prefixes of all rebuilt conversations, and each node joined with those above it.
SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, h) AS turns FROM t GROUP BY 1),
z AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc_table),
k AS (SELECT c, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(c::VARCHAR, '.'), lambda s: ascii(s)::BIGINT)),
    lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 9 AS h FROM o, z),
r AS (SELECT k.c, list_concat(coalesce(b.turns, [])[1:k.h], k.turns[k.h + 1:]) AS turns FROM k LEFT JOIN k AS b ON b.c = k.c - k.c % 5),
p AS (SELECT c, d, turns[1:d] AS node, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, node, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends FROM p GROUP BY 1, 2),
f AS (SELECT n.*, u.c AS parent FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.node = n.node[1:n.d - 1]),
q AS (SELECT d - 1 AS d, parent AS c, count(*) AS kids FROM f WHERE parent IS NOT NULL GROUP BY 1, 2),
e AS (SELECT f.*, coalesce(kids, 0) AS kids, CASE WHEN f.d = 0 THEN 0 ELSE (n - 1) * strlen(node[f.d].text) END AS saved FROM f LEFT JOIN q ON q.d = f.d AND q.c = f.c),
s AS (SELECT a.d, a.c, count(*) FILTER (e.kids = 0) AS leaves, sum(e.saved) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM e) AS e JOIN e AS a ON a.d = e.up AND a.node = e.node[1:e.up] GROUP BY 1, 2)
SELECT e.c AS conv_id, e.d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM e JOIN s USING (d, c)
"""
