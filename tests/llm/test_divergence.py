"""The audit against sums term by term, with nulls, empty and long texts, ties, repeated rows, odd columns, and groups cut into blocks and tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracework.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, docs int, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or ""].add(source or "")
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda c, of: 1 + 10**9 * (c + 5) // (of + 5 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(n[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def table():
    r = random.Random(8)
    words = ["Ab", "ab", "éa", "É", "x1y", "zz-top", "the", "of", *["".join(r.choice("abcdefß") for _ in range(3)) for _ in range(60)]]
    rows = [(" ".join(r.choice(words[: r.choice([5, 68])]) for _ in range(r.randint(0, 60))), r.choice(["en", "de"]), f"s{r.choice([0, 0, 0, r.randint(0, 11)])}") for _ in range(300)]
    rows += [(None, "en", "silent"), ("", None, None), ("the of the", None, "s1"), ("one " * 3, "xx", "a"), ("two", "xx", "b"), ("the " * 50_000 + "of", "en", "s3")]
    return rows + rows[:7]


@pytest.mark.parametrize(("block", "tile"), [(7, 3), (divergence.BLOCK, divergence.TILE)])
def test_audit_equals_sums_term_by_term(spark, block, tile, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 90)
    monkeypatch.setattr(divergence, "PIECE", 40)
    rows = table()
    df = spark.createDataFrame([(1, *x, "t", 1, 1, "v") for x in rows], SCHEMA).repartition(3)
    got = divergence.audit(df, 6, 9, block, tile).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == plain(rows, 6, 9)


def test_empty_table(spark):
    assert divergence.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_nodes_are_one_and_priced_once():
    r = np.random.default_rng(2)
    counts = np.zeros((6, 1000), np.int64)
    counts[1, r.integers(0, 1000, 20)] = 3
    counts[2] = counts[1]
    counts[3] = r.integers(0, 4, 1000)
    counts[4, :512] = counts[3, :512]
    values, levels, roots = divergence.consed(counts)
    assert roots[1] == roots[2] and roots[0] != roots[1]
    def unfold(node, k):
        return [node] if k == 0 else unfold(levels[k - 1][0][node], k - 1) + unfold(levels[k - 1][1][node], k - 1)
    for g in range(6):
        assert values[np.array(unfold(roots[g], len(levels)))[:1000]].tolist() == counts[g].tolist()
    assert all(len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a) for a, b in levels)
    who, a, b, places = divergence.met(0, np.array([1, 2, 5]), levels, roots)
    # Zero against zero (and the void places of both) is one pair each, however many places there are.
    assert places.sum() == 3 * 1024 and (who == 2).sum() == 2 and (who == 0).sum() == 3
    totals = counts.sum(1).tolist()
    want = {(g, h): int(sum(abs(divergence.shares(counts[g], totals[g], 1000) - divergence.shares(counts[h], totals[h], 1000)))) for g in range(6) for h in range(g + 1, 6)}
    assert {(g, h): v for g, h, v in divergence.apart(counts, totals, 1000, np.ones((6, 6), bool))} == want


def test_shares_are_exact():
    for total, v in ((1, 1), (10**15, 10**6), (7, 3), (8 * 10**15, 10**7)):
        c = np.array([0, 1, total // 3, total - 1, total])
        assert divergence.shares(c, total, v).tolist() == [1 + 10**9 * (int(x) + 5) // (total + 5 * v) for x in c]
