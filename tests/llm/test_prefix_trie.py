"""The trie against sets of prefixes, over one range and over many, with nulls, ties, repeated rows, long and turnless conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracework.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path int, `key` long, n_convs int"


def plain_trie(convs):
    """convs: id to list of (role, text)."""
    members, last = defaultdict(set), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_of(rows):
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found[c].append((turn is not None, turn or 0, h, (role, text)))
    return {c: [x[-1] for x in sorted(v)] for c, v in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def rows_of(seed, n=160):
    r = random.Random(seed)
    said = ["", None, "yes", "no é", "why?", "x" * 5000]
    rows = []
    for c in [*range(n), 10_000, 10_004, 7_777_777]:
        if c % 17 == 3:
            continue
        hot = c % 3 == 0
        for t in range(r.randint(1, 9) if c != 40 else 300):
            text = "hot" if hot and t < 4 else r.choice(said)
            rows.append((c, t if r.random() > 0.1 else None, r.choice(["user", None]) if not hot else "user", text, "d", 1, 2, 3))
    return [*rows, (None, 1, "user", "nobody", "d", 1, 2, 3), rows[3], rows[3], (5, 1, "a", "b", "d", 1, 2, 3)]


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("range_bytes", [600, 5000, prefix_trie.RANGE_BYTES])
def test_digest_equals_sets_of_prefixes(spark, range_bytes):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.digest(df, range_bytes).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rebuilt(turns_of(rows))), key=repr)


def test_plain_conversations_with_their_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = rows_of(9, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = prefix_trie.trie(prefix_trie.paths(df), 900)
    own = turns_of(rows)
    got = prefix_trie.with_turns(nodes, df.select("conv_id", "turn", "role", "text")).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(plain_trie(own), key=repr)
    assert all((r["role"], r["text"]) == (own[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None)) for r in got)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([(None, 1, "a", "b", "d", 1, 2, 3)], SCHEMA)
    assert prefix_trie.digest(df).count() == 0 and prefix_trie.digest(df.limit(0)).count() == 0
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)  # loses its only turn, has no family head
    got = prefix_trie.digest(spark.createDataFrame([(c, 1, "a", "b", "d", 1, 2, 3)], SCHEMA)).collect()
    assert [tuple(r[x] for x in COLUMNS) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
