"""Suffix-array deduplication by a common-prefix-aware distributed merge sort.

A byte goes if a string of 200 bytes that covers it also starts anywhere else in the corpus. To find those strings without
sorting a suffix for every byte, suffixes start at anchors: the anchor of a 200-byte window is the first position of the
least hash of 32 bytes within it, so that equal windows have equal anchors at equal offsets. For every anchor two strings are
sorted, what follows it and what precedes it (read backwards), each as far as its windows reach.

Batches of documents sort their anchors' strings into runs, front-code them (length of the prefix shared with the string
before, and the rest), and send each group of anchors one run. A group merges the runs of all batches with a loser tree that
carries the common prefix with the last string put out: players are compared by that number, and by bytes only beyond it, so no
known prefix is ever compared again. From the two merged orders and their common-prefix lengths follows, for each offset, which
windows are equal, byte for byte.

Windows whose inner 151 bytes have a hash that no other window of the corpus has cannot repeat and are not sent (an exchange of
packed hashes tells); a batch sends equal strings once, marked as repeated.

Defined cases: null and empty texts have no bytes; texts under 200 bytes keep all; rows that repeat a doc_id and a text are copies
of each other like any others; null doc_ids sort first; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tracework.llm import exchange
from tracework.llm.exchange import pack, releasing, table_of, unpack

WINDOW, GRAM = 200, 32
REACH = WINDOW - GRAM + 1  # places for an anchor in a window
CHUNK = 50  # offsets whose windows have an inner string in common
INNER = WINDOW - CHUNK + 1
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n bytes from those of n bytes."""
    out = h[:-n] * _P
    out += h[n:]
    out ^= out >> np.uint64(29)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


class Anchors:
    """Runs of windows with one anchor: p (anchor), low and high (first and last window start), and the hashes of inner strings."""

    def __init__(self, data: np.ndarray, n: np.ndarray):
        self.data = data
        total = len(data)
        none = np.zeros(0, np.int64)
        self.p = self.low = self.high = none
        self.chunk_of, self.chunk, self.inner = none, none, np.zeros(0, np.uint64)
        m = total - WINDOW + 1
        if m <= 0:
            return
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        starts = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        del doc
        if not len(starts):
            return
        h = data.astype(np.uint64)
        h += np.uint64(1)
        h *= _Q
        for k in (1, 2, 4, 8, 16):
            h = _doubled(h, k)
        least = _mixed(h) & np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=np.uint64)
        for k in (1, 2, 4, 8, 16, 32, 64):
            least = np.minimum(least[:-k], least[k:])
        least = np.minimum(least[: m], least[REACH - 128 : REACH - 128 + m])
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del least
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
        self.p, self.low = at[new], starts[new]
        self.high = starts[np.append(new[1:], len(starts)) - 1]
        for k in (32, 64):
            h = _doubled(h, k)
        # Chunks of offsets that each run meets, and the inner string of each.
        first, last = (self.p - self.high) // CHUNK, (self.p - self.low) // CHUNK
        k = last - first + 1
        self.chunk_of = np.repeat(np.arange(len(k)), k)
        chunk = np.repeat(first, k) + np.arange(len(self.chunk_of)) - np.repeat(np.cumsum(k) - k, k)
        s = self.p[self.chunk_of] - CHUNK * chunk
        self.inner = _mixed(h[s] * _P + h[s + INNER - 128] + chunk.astype(np.uint64))
        self.chunk = chunk

    def narrowed(self, keep: np.ndarray) -> np.ndarray:
        """Cut runs to the span of their kept chunks; the numbers of the runs that stay."""
        run, chunk = self.chunk_of[keep], self.chunk[keep]
        if not len(run):
            return run
        runs, at = np.unique(run, return_index=True)
        last = np.append(at[1:], len(run)) - 1
        self.high[runs] = np.minimum(self.high[runs], self.p[runs] - CHUNK * chunk[at])
        self.low[runs] = np.maximum(self.low[runs], self.p[runs] - CHUNK * chunk[last] - CHUNK + 1)
        return runs


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - 1 - (x.bit_length() - 1) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(common prefix with the string before, length, rests) of sorted strings."""
    shared = [0] * len(strings)
    for k in range(1, len(strings)):
        shared[k] = common(strings[k - 1], strings[k])
    return np.array(shared, np.uint16), np.array([len(x) for x in strings], np.uint16), b"".join(x[k:] for x, k in zip(strings, shared, strict=True))


def decoded(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for k, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:k] + rests[at : at + n - k]
        at += n - k
        out.append(before)
    return out


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs: (run, place in it, common prefix with the string before) in order.

    A loser tree; the players' `lcp` is their common prefix with the last string put out. The larger one wins; at equal ones
    bytes decide from there on, and the loser keeps what it has in common with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    place, lcp, loser = [0] * k, [0] * k, [0] * k

    def beats(a: int, b: int) -> bool:
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        at = common(x, y, lcp[a])
        if at == len(x) or (at < len(y) and x[at] < y[at]):
            lcp[b] = at
            return True
        lcp[a] = at
        return False

    winner = list(range(k))
    level = k
    tree = [0] * k + winner
    while level > 1:
        level //= 2
        for i in range(level, 2 * level):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i], loser[i] = (a, b) if beats(a, b) else (b, a)
    w = tree[1] if k > 1 else 0
    order, places, prefixes = [], [], []
    while head[w] is not None:
        order.append(w)
        places.append(place[w])
        prefixes.append(lcp[w])
        place[w] += 1
        if place[w] < len(runs[w]):
            head[w], lcp[w] = runs[w][place[w]], shared[w][place[w]]
        else:
            head[w] = None
        i = (w + k) // 2
        while i:
            if not beats(w, loser[i]):
                w, loser[i] = loser[i], w
            i //= 2
    return order, places, prefixes


def run_message(after: list[bytes], before: list[bytes], least: np.ndarray, most: np.ndarray, repeated: np.ndarray) -> bytes:
    """One batch's anchors for one group, sorted by what follows: both front-coded runs, offsets and marks."""
    back = sorted(range(len(before)), key=before.__getitem__)
    a, b = front_coded(after), front_coded([before[k] for k in back])
    parts = [pack(a[0]), pack(a[1]), pack(np.frombuffer(a[2], np.uint8)), pack(b[0]), pack(b[1]), pack(np.frombuffer(b[2], np.uint8)), pack(np.array(back, np.int32)), pack(least.astype(np.uint8)), pack(most.astype(np.uint8)), pack(repeated.astype(np.uint8))]
    return b"".join([*(len(x).to_bytes(4, "little") for x in parts), *parts])


def read_run(x: bytes) -> list:
    n = [int.from_bytes(x[4 * k : 4 * k + 4], "little") for k in range(10)]
    at = np.concatenate(([40], 40 + np.cumsum(n)))
    kinds = [np.uint16, np.uint16, np.uint8, np.uint16, np.uint16, np.uint8, np.int32, np.uint8, np.uint8, np.uint8]
    return [unpack(x[at[k] : at[k + 1]], kind) for k, kind in enumerate(kinds)]


def repeats(messages: list[bytes]) -> list[np.ndarray]:
    """For each message: for each of its anchors and windows, largest offset first, whether the window occurs twice or more."""
    got = [read_run(x) for x in messages]
    sizes = np.array([len(g[7]) for g in got])
    base = np.concatenate(([0], np.cumsum(sizes)))
    total = int(base[-1])
    ranks, prefixes = [], []
    for shared, lengths, rests, back in ((0, 1, 2, None), (3, 4, 5, 6)):
        runs = [decoded(g[shared], g[lengths], g[rests].tobytes()) for g in got]
        run, place, prefix = merged(runs, [g[shared].tolist() for g in got])
        del runs
        run, place = np.array(run), np.array(place)
        who = base[run] + place
        if back is not None:
            who = np.concatenate([b + g[back] for b, g in zip(base, got, strict=False)])[who]
        ranks.append(who)
        prefixes.append(np.array(prefix))
    least, most, weight = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (7, 8, 9))
    first = np.cumsum(most - least + 1) - (most - least + 1)
    out = np.zeros(int((most - least + 1).sum()), bool)
    mine, theirs = np.empty(total, np.int64), np.empty(total, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        live = np.flatnonzero((least <= o) & (o <= most))
        if not len(live):
            continue
        mine[ranks[0]] = np.cumsum(prefixes[0] < WINDOW - o)
        theirs[ranks[1]] = np.cumsum(prefixes[1] < o)
        _, which = np.unique(mine[live] * (total + 1) + theirs[live], return_inverse=True)
        n = np.bincount(which, 1 + weight[live])
        out[first[live] + most[live] - o] = n[which] > 1
    return np.split(out, np.cumsum([int((g[8].astype(np.int64) - g[7] + 1).sum()) for g in got])[:-1])


def distinct_strings(data: np.ndarray, low: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of equal strings data[low:low+n] with equal anchor offsets, which one each equals), compared byte by byte."""
    key = (p - low) * 512 + n
    for k in range(8):
        at = low + (n - 1) * k // 7
        key = key * 1000003 ^ data[at]
    at, left = low.copy(), n.copy()
    h = np.zeros(len(low), np.uint64)
    for t in range(int(n.max()) if len(n) else 0):
        live = t < left
        h = np.where(live, h * _P + data[np.where(live, at + t, 0)] + np.uint64(1), h)
    _, first, which = np.unique(h ^ _mixed(key.astype(np.uint64)), return_index=True, return_inverse=True)
    ok = (n == n[first][which]) & (p - low == (p - low)[first][which])
    twins = np.flatnonzero(ok & (first[which] != np.arange(len(which))))
    for t in range(int(n[twins].max()) if len(twins) else 0):
        live = t < n[twins]
        ok[twins] &= ~live | (data[np.where(live, low[twins] + t, 0)] == data[np.where(live, low[first[which[twins]]] + t, 0)])
    odd = np.flatnonzero(~ok)  # of one hash but not equal: each stands for itself
    which = which.copy()
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), which


def removals(docs: DataFrame, finish, schema: str) -> DataFrame:
    """finish(doc_ids, texts, covered) -> table, over every batch of documents."""
    batches, buckets, bits = exchange.plan(docs)
    dealt = exchange.batched(docs, batches)
    shift = np.uint64(64 - bits)

    def anchored(table):
        _, data, names = exchange.in_order(table)
        return data, names, Anchors(np.frombuffer(b"".join(data), np.uint8), np.array([len(x) for x in data], np.int64))

    sent_schema = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("counts", pa.binary())])

    def send(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        _, _, a = anchored(table)
        return table_of([(batch, *x) for x in exchange.sent(np.unique(a.inner >> shift), bits, buckets)], sent_schema)

    first = exchange.answers(dealt.groupBy("batch").applyInArrow(releasing(send), "batch int, bucket int, payload binary, counts binary"))
    group_schema = pa.schema([("batch", pa.int32()), ("group", pa.int32()), ("payload", pa.binary())])

    def sort_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table_of([], group_schema)
        batch = left.column("batch")[0].as_py()
        _, _, a = anchored(left)
        got = sorted((r["bucket"], r["reply"]) for r in right.to_pylist())
        elsewhere = np.concatenate([unpack(x, np.uint8) for _, x in got]) > 1
        _, inverse, n = np.unique(a.inner >> shift, return_inverse=True, return_counts=True)
        runs = a.narrowed(np.flatnonzero((elsewhere | (n > 1))[inverse]))
        if not len(runs):
            return table_of([], group_schema)
        p, low, high = a.p[runs], a.low[runs], a.high[runs]
        one, which = distinct_strings(a.data, low, high - low + WINDOW, p)
        times = np.bincount(which)
        raw = a.data.tobytes()
        at, start, end = p[one].tolist(), low[one].tolist(), (high[one] + WINDOW).tolist()
        after = [raw[x:y] for x, y in zip(at, end, strict=True)]
        group = np.array([int.from_bytes(hashlib.blake2b(x[:GRAM], digest_size=4).digest()) % buckets for x in after])
        order = sorted(range(len(one)), key=lambda k: (group[k], after[k]))
        rank = np.empty(len(one), np.int64)
        rank[order] = np.arange(len(one))
        order = np.array(order)
        group = group[order]
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        rows = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[x:y]
            before = [raw[start[k] : at[k]][::-1] for k in own]
            k = one[own]
            rows.append((batch, int(group[x]), run_message([after[k] for k in own], before, p[k] - high[k], p[k] - low[k], times[own] > 1)))
        parts = [pack(np.diff(low, prepend=0).astype(np.int32)), pack((high - low + 1).astype(np.uint8)), pack(rank[which].astype(np.int32))]
        rows.append((batch, -1 - batch, b"".join([*(len(x).to_bytes(8, "little") for x in parts), *parts])))
        return table_of(rows, group_schema)

    spread = dealt.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(releasing(sort_runs), "batch int, group int, payload binary")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["group"].iloc[0] < 0:  # what a batch needs to know again of itself
            return pdf[["batch", "group", "payload"]]
        pdf = pdf.sort_values("batch")
        got = repeats(list(pdf["payload"]))
        return pd.DataFrame({"batch": pdf["batch"].to_numpy(), "group": pdf["group"].to_numpy(), "payload": [len(x).to_bytes(8, "little") + pack(np.packbits(x)) for x in got]})

    told = spread.groupBy("group").applyInPandas(releasing(merge), "batch int, group int, payload binary")

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        _, data, names = exchange.in_order(left)
        total = sum(map(len, data))
        covered = np.zeros(total, bool)
        got = dict(sorted((r["group"], r["payload"]) for r in right.to_pylist()))
        if got:
            own = got.pop(min(got))
            size = [int.from_bytes(own[8 * k : 8 * k + 8], "little") for k in range(3)]
            at = np.concatenate(([24], 24 + np.cumsum(size)))
            low, n, which = (unpack(own[at[k] : at[k + 1]], kind) for k, kind in enumerate((np.int32, np.uint8, np.int32)))
            low, n = np.cumsum(low, dtype=np.int64), n.astype(np.int64)
            flags = np.concatenate([np.unpackbits(unpack(x[8:], np.uint8), count=int.from_bytes(x[:8], "little")) for x in got.values()])
            length = np.zeros(which.max() + 1, np.int64)
            length[which] = n
            begin = np.cumsum(length) - length
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = np.zeros(total + 1, np.int32)
            starts[(np.repeat(low, n) + inside)[flags[np.repeat(begin[which], n) + inside] > 0]] = 1
            c = np.concatenate((np.zeros(WINDOW, np.int32), np.cumsum(starts[:-1], dtype=np.int32)))
            covered = c[WINDOW:] > c[:-WINDOW]
        return finish(names, data, covered)

    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(releasing(end), schema)


def _digests(names: list, data: list[bytes], covered: np.ndarray) -> pa.Table:
    rows, at = [], 0
    for i, x in zip(names, data, strict=True):
        gone = covered[at : at + len(x)]
        at += len(x)
        n = int(gone.sum())
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if n else 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes() if n else x
        rows.append((i, len(x), n, spans, hashlib.sha256(kept).hexdigest()))
    return table_of(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def digest(docs: DataFrame) -> DataFrame:
    return removals(docs, _digests, OUT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, data): the remaining bytes of each document."""

    def kept(names, data, covered):
        rows, at = [], 0
        for i, x in zip(names, data, strict=True):
            rows.append((i, np.frombuffer(x, np.uint8)[~covered[at : at + len(x)]].tobytes()))
            at += len(x)
        return table_of(rows, pa.schema([("doc_id", pa.int64()), ("data", pa.binary())]))

    return removals(docs, kept, "doc_id long, data binary")
