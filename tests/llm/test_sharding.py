"""Shards against one heap over all groups, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tracework.llm import sharding

SCHEMA = "doc_id long, text string, shard string, place int, `key` string, total long"


def plain_dealt(sizes, shards):
    heap, out = [(0, k) for k in range(shards)], []
    for s in sizes:
        load, k = heapq.heappop(heap)
        out.append(k)
        heapq.heappush(heap, (load + s, k))
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_heap_by_runs(shards):
    r = random.Random(shards)
    for _ in range(150):
        sizes = sorted((r.choice([1, 2, 3, 17, 100, r.randint(1, 5000)]) for _ in range(r.randint(0, 400))), reverse=True)
        sizes = [max(sizes, default=0) * 30 + 1] * r.randint(0, 2) + sizes  # a few groups above the mean shard
        runs = sorted(Counter(sizes).items(), reverse=True)
        got = [None] * len(sizes)
        rows = list(sharding.dealt(iter(runs), shards))
        for _, start, end, turn in rows:
            for i in range(start, end):
                got[i] = turn[(i - start) % len(turn)]
        assert got == plain_dealt(sizes, shards)
        assert len(rows) <= 2 * (shards + 1) * len(runs)


def test_a_run_of_many_groups_is_few_stretches():
    rows = list(sharding.dealt(iter([(10**9, 1), (500, 3), (100, 10**12)]), 40))
    assert len(rows) < 100 and rows[-1][2] == 10**12 + 4


def texts():
    r = random.Random(5)
    some = [" ".join(r.choice(["a", "bb", "éé", "ß", "word"]) for _ in range(r.randint(0, 30))) for _ in range(120)]
    return [None, "", "x" * 60_000, "one", *some, *some[:40], *(["hot copy"] * 150)]


@pytest.mark.parametrize("rows_a_range", [20, 1_000_000])
def test_shards_equal_one_heap(spark, rows_a_range):
    import hashlib

    rows = [(i * 7 % 1000 if i != 9 else None, t, "s", 1, "k", 2) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5]]
    got = sharding.sharded(spark.createDataFrame(rows, SCHEMA).repartition(5), 6, rows_a_range).collect()
    assert len(got) == len(rows)
    groups = defaultdict(int)
    for _, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    order = sorted(groups, key=lambda t: (-groups[t], hashlib.md5(t.encode()).digest()))
    shard = dict(zip(order, plain_dealt([groups[t] for t in order], 6), strict=True))
    want = sorted(repr((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), shard[t or ""])) for i, t, *_ in rows)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"], r["shard"])) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["place"], -(2**63) if r["doc_id"] is None else r["doc_id"]))
    for s in slots.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s))) and [x[1:] for x in s] == sorted(x[1:] for x in s)


def test_empty_table_and_files(spark, tmp_path):
    rows = [(i, t, f"{i}", i, "k", 2) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sharding.digest(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    place = {r["doc_id"]: r["shard"] for r in sharding.sharded(df, 5).collect()}
    assert all(place[r["doc_id"]] == r["_shard"] for r in back.collect())
