"""What a task makes of one range of time: the areas under the distances of all views, and each key's part of them.

Spark cuts time, clips instances and sends each range to a task (sweep.Sweep.pieces); here the boundaries of a range are sorted once
for all views, and once a view by key. All that a view needs are sums along these two orders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = "view string, _range int, key array<string>, first double, last double, value double"
_ARROW = pa.schema([("view", pa.string()), ("_range", pa.int32()), ("key", pa.list_(pa.string())), ("first", pa.float64()), ("last", pa.float64()), ("value", pa.float64())])
#: Rows of a batch of keys that a task sends back.
ROWS_A_BATCH = 100_000


def measuring(views: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], names: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (_range, kind, s, t, side, parts as texts): rows of SCHEMA.

    views: name to the columns of the key's parts and the kinds of rows that the view counts. A view's own row (key null) has its first and
    last boundary and the area of its distance; with names, each key whose counts differ for some time has a row with its part of that area.
    """
    texts = sorted({c for parts, _ in views.values() for c in parts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts become numbers batch by batch: a range is held without its texts' copies.
        small = []
        for b in batches:
            cols = [b.column(c).dictionary_encode() if c in texts or c == "kind" else b.column(c) for c in b.schema.names]
            small.append(pa.RecordBatch.from_arrays(cols, names=b.schema.names))
        if not small:
            return
        table = pa.Table.from_batches(small).unify_dictionaries().combine_chunks()
        del small
        at = table.column("_range").to_numpy()
        for r in np.unique(at):  # one, where a task has one range
            yield from measured(table if at[0] == r and (at == r).all() else table.filter(pc.equal(table.column("_range"), int(r))), int(r))
        pa.default_memory_pool().release_unused()

    def measured(table: pa.Table, r: int) -> Iterator[pa.RecordBatch]:
        s, t = (table.column(c).to_numpy() for c in "st")
        one_log = np.where(table.column("side").to_numpy() == 0, 1, -1).astype(np.int8)
        dictionaries, codes = {}, {}
        for c in [*texts, "kind"]:
            col = table.column(c).combine_chunks()
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            codes[c], dictionaries[c] = col.indices.to_numpy(), col.dictionary
        kinds = {k: i for i, k in enumerate(dictionaries["kind"].to_pylist())}
        n = len(s)
        time = np.concatenate([s, t])
        order = np.argsort(time).astype(np.int32)
        del s, t
        for of in dict.fromkeys(of for _, of in views.values()):  # views of the same rows have one line of time, held while they are measured
            counted = np.isin(codes["kind"], [kinds[k] for k in of if k in kinds])
            if counted.any():
                held = line(time, order, one_log, counted)
                for view, (parts, own) in views.items():
                    if own == of:
                        yield from one_view(view, r, parts, codes, dictionaries, *held)

    def one_view(view, r, parts, codes, dictionaries, piece, x, now, weight) -> Iterator[pa.RecordBatch]:
        code, found = numbers([codes[c] for c in parts], [len(dictionaries[c]) for c in parts])
        # By key, then time: both logs' counts of a key differ by a running sum, which is 0 again after its last boundary.
        bits = max(1, int(len(piece) - 1).bit_length())
        by_key = code[piece]
        by_key <<= bits
        by_key |= np.arange(len(piece))
        by_key.sort()
        place = (by_key & ((1 << bits) - 1)).astype(np.int32)
        by_key >>= bits
        apart = np.cumsum(x[place], dtype=np.int32)
        np.abs(apart, out=apart)
        change = np.empty(len(piece), np.int32)
        change[place] = np.diff(apart, prepend=np.int32(0))
        area = float(np.dot(np.cumsum(change, dtype=np.float64)[:-1], weight))
        yield pa.RecordBatch.from_arrays([pa.array([view]), pa.array([r], pa.int32()), pa.array([None], pa.list_(pa.string())), *[pa.array([v], pa.float64()) for v in (now[0], now[-1], area)]], schema=_ARROW)
        if names:
            del change
            yield from keys_of(view, r, parts, codes, dictionaries, code, found, by_key[:-1], apart[:-1], now[place], np.concatenate([[0.0], np.cumsum(weight)])[place])

    def keys_of(view, r, parts, codes, dictionaries, code, found, key, apart, now, f) -> Iterator[pa.RecordBatch]:
        """With f the running integral of 1 / total, a key that is apart by c over [s, e) contributes c (f(e) - f(s))."""
        share = np.bincount(key, apart * np.diff(f), found)
        kept = np.flatnonzero(np.bincount(key[(apart > 0) & (np.diff(now) > 0)], minlength=found))
        first = np.empty(found, np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        for k in range(0, len(kept), ROWS_A_BATCH):
            some = kept[k : k + ROWS_A_BATCH]
            m, words = len(some), [dictionaries[c].take(pa.array(codes[c][first[some]])) for c in parts]
            inner = pa.concat_arrays(words).take(pa.array(np.arange(len(words) * m).reshape(len(words), m).T.ravel()))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) * m + 1, len(words)), pa.int32()), inner)
            none = pa.nulls(m, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.repeat(view, m), pa.repeat(pa.scalar(r, pa.int32()), m), keys, none, none, pa.array(share[some])], schema=_ARROW)

    def line(time, order, one_log, counted):
        """Of the counted rows' boundaries along time: row, change of the logs' difference, time; and the length up to the next over the total."""
        n = len(counted)
        mine = order if counted.all() else order[counted[np.where(order < n, order, order - n)]]
        piece = np.where(mine < n, mine, mine - n)
        d = np.where(mine < n, 1, -1).astype(np.int8)
        now, total = time[mine], np.cumsum(d, dtype=np.int64)[:-1]
        dt = np.diff(now).astype(np.float64)
        return piece, d * one_log[piece], now, np.divide(dt, total, out=np.zeros(len(total)), where=(dt > 0) & (total > 0))

    def numbers(codes, sizes):
        """(number of each row's key, how many): texts' numbers put together, from 0 without gaps."""
        code, size = codes[0].astype(np.int64), sizes[0]
        for more, n in zip(codes[1:], sizes[1:], strict=True):
            got = pa.array(code * n + more).dictionary_encode()
            code, size = got.indices.to_numpy().astype(np.int64), len(got.dictionary)
        return code, size

    return run
