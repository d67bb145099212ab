"""Substring deduplication by prefix-partitioned suffix trees over words.

Suffixes of the documents' word sequences are split by variable-length prefixes into memory-sized groups: the first three words
say the group, or, where more than FREQUENT windows of the whole corpus share a prefix, the first four, and so on, as far as the
window goes (equal windows are sent once a batch). So that neighbours travel together, the prefix that places a suffix is that of
its anchor, the three words of least hash within the 13 that follow: equal windows have equal anchors at equal offsets, and runs
of suffixes with one anchor are sent as one stretch of words.

A group's task grows the subtree of its suffixes from the root, level by level; nodes that hold a single suffix end as leaves. From
depth 13 on an edge runs on as long as all suffixes of the node go on alike, over as many words as they share in the group: so each
deep internal node gets its full depth and the least doc_id among its leaves. These nodes are the maximal repeats, and every
occurrence in a document that is not the least loses all the node's words.

Two things more keep the exchange small and whole. A suffix whose 13-word window is the only one with its hash, over all batches,
cannot meet another in any subtree and is a leaf from the start; it is not sent. And a batch sends equal windows once, with
their least doc_id. Groups compare words themselves, coded by a dictionary of each message, never hashes.

A word goes if a window of 13 words that covers it also starts in a document with a smaller doc_id.

Defined cases: null and empty texts have no words; texts of fewer than 13 words keep all; a null doc_id is smaller than all
others; rows that repeat a doc_id do not take from one another; an empty table gives an empty result; other columns do not
matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tracework.llm import exchange
from tracework.llm.exchange import pack, releasing, table_of, unpack

WINDOW = 13
#: Words of an anchor, windows of the corpus from which a prefix is frequent and lengthened, and of how many windows one is counted for it.
ANCHOR, FREQUENT, SAMPLE = 3, 200_000, 2048
#: Bytes of text whose repeated suffixes meet in one group, about, and the least number of groups.
GROUP, LEAST_GROUPS = 48 << 20, 16
_P = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """The words of a batch as codes, with its windows."""

    def __init__(self, data: list[bytes]):
        split = [x.split() for x in data]  # bytes split at ASCII white space alone
        self.n = np.array([len(x) for x in split], np.int64)
        flat = np.empty(int(self.n.sum()), object)
        flat[:] = [w for x in split for w in x]
        self.codes, self.vocabulary = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, object))
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], np.uint64)
        self.hashes = known[self.codes] if len(flat) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        m = len(flat) - WINDOW + 1
        self.starts = np.flatnonzero(self.doc[:m] == self.doc[WINDOW - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def prefix_hashes(self, length: int, starts: np.ndarray) -> np.ndarray:
        h = np.full(len(starts), length, np.uint64)
        for k in range(length):
            h *= _P
            h += self.hashes[starts + k]
            h ^= h >> np.uint64(31)
        return h

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        if not len(self.starts):
            return self.starts
        h = self.prefix_hashes(ANCHOR, np.arange(len(self.hashes) - ANCHOR + 1))
        h *= _P
        h ^= h >> np.uint64(32)
        h *= _P
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        for k in (1, 2, 4):
            least = np.minimum(least[:-k], least[k:])
        last = WINDOW - ANCHOR + 1 - 8
        least = np.minimum(least[:-last], least[last:])
        return (least[self.starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def window_hashes(self) -> np.ndarray:
        m = len(self.hashes) - WINDOW + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            h *= _P
            h += self.hashes[k : k + m]
            if k % 4 == 3:
                h ^= h >> np.uint64(29)
        h ^= h >> np.uint64(32)
        h *= _P
        h ^= h >> np.uint64(29)
        return h[self.starts]


def sampled_prefixes(w: Words) -> list[tuple[int, int]]:
    """(prefix hash, count) of the anchors' prefixes of every length, over one in SAMPLE of the batch's windows."""
    out, anchors = [], w.anchors()[::SAMPLE]
    ends = w.starts[::SAMPLE] + WINDOW
    for length in range(ANCHOR, WINDOW + 1):
        known, n = np.unique(w.prefix_hashes(length, anchors[anchors + length <= ends]), return_counts=True)
        out += list(zip(known.view(np.int64).tolist(), n.tolist(), strict=True))
    return out


def groups_of(w: Words, starts: np.ndarray, anchors: np.ndarray, frequent: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix: by the shortest prefix of its anchor that is not frequent, or the longest within its window."""
    key = w.prefix_hashes(ANCHOR, anchors)
    open_ = np.arange(len(anchors))
    for length in range(ANCHOR + 1, WINDOW + 1):
        open_ = open_[np.isin(key[open_], frequent)]
        open_ = open_[anchors[open_] + length <= starts[open_] + WINDOW]
        if not len(open_):
            break
        key[open_] = w.prefix_hashes(length, anchors[open_])
    return ((key >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)


def deep_nodes(m: np.ndarray) -> np.ndarray:
    """Grow the subtree of suffixes given as rows of word codes, two levels at a time where numbers allow; the node at full depth
    of each suffix, or -1 for a leaf above."""
    node = np.zeros(len(m), np.int64)
    live = np.arange(len(m))
    size, level = int(m.max()) + 1 if len(m) else 1, 0
    while level < m.shape[1] and len(live):
        key = node[live] * size + m[live, level].astype(np.int64)
        level += 1
        if level < m.shape[1] and (int(node[live].max()) + 1) * size * size < 1 << 62:
            key = key * size + m[live, level]
            level += 1
        _, child, n = np.unique(key, return_inverse=True, return_counts=True)
        node[live] = child
        alone = n[child] == 1
        node[live[alone]] = -1
        live = live[~alone]
    return node


def repeats(m: np.ndarray, follows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The deep internal nodes of a subtree: (node of each suffix or -1, head of each node's edge, depth and least doc_id of heads).

    m has a row of WINDOW word codes for each suffix; follows says whether the row before is the suffix one word earlier. A node
    whose suffixes all go on to one node, which all its suffixes come from, lies on that node's edge: the edge's first node, its
    head, has the depth of the edge's end, and all nodes of an edge have the same occurrences, one word on.
    """
    node = deep_nodes(m)
    count = int(node.max()) + 1 if len(node) else 0
    deep = np.flatnonzero(node >= 0)
    after, before = np.full(len(node), -1), np.full(len(node), -1)
    link = np.flatnonzero(follows[1:]) + 1
    after[link - 1], before[link] = node[link], node[link - 1]

    def only(to: np.ndarray) -> np.ndarray:
        """The one node that all suffixes of a node have beside them, or -1."""
        low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, -2)
        np.minimum.at(low, node[deep], to[deep])
        np.maximum.at(high, node[deep], to[deep])
        return np.where(low == high, low, -1)

    on, back = only(after), only(before)
    size = np.bincount(node[deep], minlength=count)
    each = np.arange(count)
    inner = (back >= 0) & (on[back] == each) & (size[back] == size)
    inner &= back != each
    head, depth = np.where(inner, back, each), np.full(count, WINDOW)
    while (head[head] != head).any():
        head = head[head]
    np.add.at(depth, head[inner], 1)
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, node[deep], ids[deep])
    return node, head, depth, least


def message(w: Words, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """Suffixes for one group, sorted by place: stretches of words (a dictionary, codes, lengths) and their doc_ids."""
    cuts = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + 1, [True])))
    suffixes = np.diff(cuts)
    length = suffixes + WINDOW - 1
    codes = w.codes[np.repeat(starts[cuts[:-1]], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
    used, local = np.unique(codes, return_inverse=True)
    small = local.astype(np.uint16 if len(used) <= 65536 else np.uint32)
    parts = [pack(np.frombuffer(b" ".join(w.vocabulary[used]), np.uint8)), pack(small), pack(suffixes.astype(np.int32)), pack(ids[cuts[:-1]])]
    return b"".join([small.itemsize.to_bytes(1, "little"), *(len(x).to_bytes(4, "little") for x in parts), *parts])


def read_message(b: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, a row of 13 codes for each suffix, doc_ids, whether a suffix follows the one before in its stretch)."""
    lengths = [int.from_bytes(b[1 + 4 * k : 5 + 4 * k], "little") for k in range(4)]
    at = np.concatenate(([17], 17 + np.cumsum(lengths)))
    part = [b[at[k] : at[k + 1]] for k in range(4)]
    codes = unpack(part[1], {2: np.uint16, 4: np.uint32}[b[0]])
    n = unpack(part[2], np.int32).astype(np.int64)
    first = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (WINDOW - 1), n)
    follows = np.ones(n.sum(), bool)
    follows[np.cumsum(n) - n] = False
    return unpack(part[0], np.uint8).tobytes().split(b" "), codes[first[:, None] + np.arange(WINDOW)], np.repeat(unpack(part[3], np.int64), n), follows


def subtree_answers(messages: list[bytes]) -> list[np.ndarray]:
    """For each message: whether the suffix's window also starts in a smaller doc_id elsewhere."""
    got = [read_message(b) for b in messages]
    flat = np.empty(sum(len(x[0]) for x in got), object)
    flat[:] = [w for x in got for w in x[0]]
    known = pd.factorize(flat)[0].astype(np.int32)
    del flat
    ids = [x[2] for x in got]
    m, at, word = np.empty((sum(map(len, ids)), WINDOW), np.int32), 0, 0
    follows = np.concatenate([x[3] for x in got])
    for k, (words, codes, *_) in enumerate(got):
        m[at : at + len(codes)] = known[word : word + len(words)][codes]
        at, word, got[k] = at + len(codes), word + len(words), None
    own = np.concatenate(ids)
    node, head, depth, least = repeats(m, follows, own)
    del m
    # Each occurrence of a repeat in a document that is not its least: from the head's suffix on, over the edge.
    begins = np.flatnonzero(node >= 0)
    begins = begins[(head[node[begins]] == node[begins]) & (least[node[begins]] < own[begins])]
    covers = np.zeros(len(own) + 1, np.int32)
    np.add.at(covers, begins, 1)
    np.add.at(covers, begins + depth[node[begins]] - WINDOW + 1, -1)
    out = np.cumsum(covers[:-1]) > 0
    return np.split(out, np.cumsum([len(x) for x in ids])[:-1])


def same_windows(w: Words, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the first of equal windows, which one each start equals); by hash, then by the words themselves."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    ok = np.ones(len(starts), bool)
    for k in range(WINDOW):
        ok &= w.codes[starts + k] == w.codes[starts[first][which] + k]
    if not ok.all():  # two windows of one hash: each of the rest stands for itself
        odd = np.flatnonzero(~ok)
        which[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate((first, odd))
    return starts[first], which


def removals(docs: DataFrame, finish, schema: str) -> DataFrame:
    """finish(doc_ids, words, covered) -> record batch, over every batch of documents."""
    batches, buckets, bits = exchange.plan(docs)
    dealt = exchange.batched(docs, batches)
    shift = np.uint64(64 - bits)

    shares = max(8, buckets // 16)
    groups = max(LEAST_GROUPS, -(-batches * exchange.BATCH // GROUP))

    def send(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        w = Words(exchange.in_order(table)[1])
        rows = [(batch, k, x, c) for k, x, c in exchange.sent(np.unique(w.window_hashes() >> shift), bits, buckets)]
        prefixes = sampled_prefixes(w)
        for k in range(shares):
            if own := [x for x in prefixes if x[0] % shares == k]:
                rows.append((batch, -1 - k, np.array(own, np.int64).tobytes(), b""))
        return table_of(rows, sent_schema)

    def sum_prefixes(payloads: list[bytes]) -> list[tuple[int, bytes]]:
        own = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in payloads])
        known, which = np.unique(own[:, 0], return_inverse=True)
        found = known[np.bincount(which, own[:, 1]) * SAMPLE >= FREQUENT]
        return [(b, found.tobytes()) for b in range(batches)] if len(found) else []

    sent_schema = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("counts", pa.binary())])
    sent = dealt.groupBy("batch").applyInArrow(releasing(send), "batch int, bucket int, payload binary, counts binary")
    first = exchange.answers(sent, sum_prefixes)

    def suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table_of([], group_schema)
        batch = left.column("batch")[0].as_py()
        ids, data, _ = exchange.in_order(left)
        w = Words(data)
        full = w.window_hashes()
        got = sorted((r["bucket"], r["reply"]) for r in right.to_pylist())
        frequent = np.frombuffer(b"".join(r[1] for r in got if r[0] < 0), np.uint64)
        elsewhere = np.concatenate([unpack(r[1], np.uint8) for r in got if r[0] >= 0] or [np.zeros(0, np.uint8)]) > 1
        _, inverse, n = np.unique(full >> shift, return_inverse=True, return_counts=True)
        keep = (elsewhere | (n > 1))[inverse] if len(full) else np.zeros(0, bool)
        starts, h = w.starts[keep], full[keep]
        if not len(starts):
            return table_of([], group_schema)
        one, which = same_windows(w, starts, h)
        anchors = w.anchors()[keep]
        group = groups_of(w, one, anchors[np.searchsorted(starts, one)], frequent, groups)
        order = np.lexsort((one, group))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        one, group = one[order], group[order]
        own = ids[w.doc[one]]
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        rows = [(batch, int(group[a]), message(w, one[a:b], own[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        places = pack(np.diff(starts, prepend=0).astype(np.int32))
        rows.append((batch, -1 - batch, len(places).to_bytes(8, "little") + places + pack(np.diff(rank[which], prepend=0).astype(np.int32))))
        return table_of(rows, group_schema)

    group_schema = pa.schema([("batch", pa.int32()), ("group", pa.int32()), ("payload", pa.binary())])
    spread = dealt.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(releasing(suffixes), "batch int, group int, payload binary")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["group"].iloc[0] < 0:  # what a batch needs to know again of itself
            return pdf[["batch", "group", "payload"]]
        pdf = pdf.sort_values("batch")
        return pd.DataFrame({"batch": pdf["batch"].to_numpy(), "group": pdf["group"].to_numpy(), "payload": [pack(x.view(np.uint8)) for x in subtree_answers(list(pdf["payload"]))]})

    told = spread.groupBy("group").applyInPandas(releasing(grow), "batch int, group int, payload binary")

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, names = exchange.in_order(left)
        split = [x.split() for x in data]
        n = np.array([len(x) for x in split], np.int64)
        cover = np.zeros(int(n.sum()) + 1, np.int32)
        got = dict(sorted((r["group"], r["payload"]) for r in right.to_pylist()))
        if got:
            own = got.pop(min(got))
            k = int.from_bytes(own[:8], "little")
            starts, which = np.cumsum(unpack(own[8 : 8 + k], np.int32), dtype=np.int64), np.cumsum(unpack(own[8 + k :], np.int32), dtype=np.int64)
            smaller = np.concatenate([unpack(x, np.uint8) for x in got.values()]).astype(bool)
            doc = ids[np.repeat(np.arange(len(n)), n)[starts]]
            first = np.full(len(smaller), np.iinfo(np.int64).max)
            np.minimum.at(first, which, doc)
            gone = starts[smaller[which] | (doc > first[which])]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
        return finish(names, split, np.cumsum(cover[:-1]) > 0)

    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(releasing(end), schema)


def _digests(names: list, split: list[list[bytes]], covered: np.ndarray) -> pa.Table:
    rows, at = [], 0
    for i, ws in zip(names, split, strict=True):
        gone = covered[at : at + len(ws)]
        at += len(ws)
        n = int(gone.sum())
        kept = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if n else ws
        rows.append((i, len(ws), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return table_of(rows, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))


def digest(docs: DataFrame) -> DataFrame:
    return removals(docs, _digests, OUT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the remaining words of each document, joined by one space."""

    def texts(names, split, covered):
        rows, at = [], 0
        for i, ws in zip(names, split, strict=True):
            rows.append((i, b" ".join(w for w, g in zip(ws, covered[at : at + len(ws)].tolist(), strict=True) if not g).decode()))
            at += len(ws)
        return table_of(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return removals(docs, texts, "doc_id long, text string")
