"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and odd columns."""

import gzip
import hashlib
import io
import random
import re
import struct

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from tracework.llm import decontaminate, fingerprints, jaccard_join, language, line_dedup, mixing, quality, substring_dedup, suffix_dedup, warc
from tracework.llm.common import least_hashed
from tracework.llm.components import components
from tracework.llm.exchange import met, pack, pack_sorted, unpack, unpack_sorted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, node string, row string, starts string, `group` int"
R = random.Random(3)
WORDS = ["".join(R.choice("abcdeéßñ") for _ in range(R.randint(1, 9))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts():
    shared, base = prose(60), prose(120)
    near = base.split()
    near[50] = "changed"
    lines = [prose(5) for _ in range(12)]
    return [
        None, "", " \n\t ", "one", "Two words", prose(4), prose(300), base, base, " ".join(near), " ".join(near[:115]), prose(20) + " " + shared + " " + prose(30), prose(9) + " " + shared,
        shared, "\n".join(lines), "\n".join(lines[3:9] + [prose(6)] + lines[:4]), "\n\n\n\n\n", "a" * 3000, "ab" * 700, ("word " * 600).strip(), prose(4000) + " " + shared, base.upper(),
        "x y z " * 40, base[:-1],
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4], len(t or ""), "b", "n", "r", "s", 1) for i, t in enumerate(texts())]
    rows += [rows[7], rows[7], (None, prose(30), "en", "s1", 1, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def by_row(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def words_of(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x)


def first(i):
    return -(2**63) if i is None else i


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_packing():
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    assert (unpack_sorted(pack_sorted(h)) == h).all() and len(unpack_sorted(pack_sorted(h[:0]))) == 0
    a = np.arange(-5, 900, dtype=np.int32)
    assert (unpack(pack(a), np.int32) == a).all()
    got = met([np.array([1, 5, 9], np.uint64), np.array([5], np.uint64)])
    assert got[0].tolist() == [1, 2, 1] and got[1].tolist() == [2]


def plain_line_dedup(rows):
    """(id, text): (lines, the numbers of those that later windows of three repeat)."""
    seen, gone, lines = {}, {}, {}
    for i, x in sorted(set(rows), key=lambda p: (first(p[0]), p[1])):
        ls = lines[i, x] = x.split("\n")
        for k in range(len(ls) - 2):
            w = tuple(s.strip(" ") for s in ls[k : k + 3])
            if any(w):
                if seen.setdefault(w, (first(i), k)) != (first(i), k):
                    gone.setdefault((i, x), set()).update(range(k, k + 3))
    return {p: (ls, gone.get(p, set())) for p, ls in lines.items()}


def test_line_dedup(docs, plain):
    found = plain_line_dedup(plain)
    want = []
    for i, x in plain:
        lines, gone = found[i, x]
        kept = [s for k, s in enumerate(lines) if k not in gone]
        want.append((i, len(lines) if x else 0, len(gone), sha("\n".join(kept))))
    assert by_row(line_dedup.digest(docs).collect(), "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert line_dedup.stage(docs).columns == docs.columns and line_dedup.digest(docs.limit(0)).count() == 0


def test_substring_dedup(docs, plain):
    least = {}
    for i, x in plain:
        w = words_of(x)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, 2**63), first(i))
    want = []
    for i, x in plain:
        w = words_of(x)
        cover = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < first(i):
                cover[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(cover), sha(" ".join(a for a, c in zip(w, cover, strict=True) if not c))))
    assert by_row(substring_dedup.digest(docs).collect(), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.digest(docs.limit(0)).count() == 0


def test_deep_nodes_are_repeats():
    m = np.random.default_rng(1).integers(0, 2, (300, 6))
    got = substring_dedup.deep_nodes(m)
    for i in range(300):
        same = [j for j in range(300) if (m[j] == m[i]).all()]
        assert (got[i] == -1) == (len(same) == 1) and all(got[j] == got[i] for j in same)


def test_deep_nodes_have_depth_and_least_document():
    """Subtrees of random stretches: occurrences that go are those of windows that a smaller document has; edges run over shared words."""
    r = np.random.default_rng(6)
    passage = r.integers(0, 50, 40)
    stretches = [np.concatenate((r.integers(0, 50, k), passage[:n], r.integers(0, 50, 3))) for k, n in ((0, 40), (3, 40), (5, 30), (2, 25))]
    m, follows, ids = [], [], []
    for d, w in enumerate(stretches):
        for k in range(len(w) - 12):
            m.append(w[k : k + 13])
            follows.append(k > 0)
            ids.append(d)
    m, follows, ids = np.array(m), np.array(follows), np.array(ids)
    node, head, depth, least = substring_dedup.repeats(m, follows, ids)
    first = {}
    for w, d in zip(m, ids, strict=True):
        first[tuple(w)] = min(d, first.get(tuple(w), d))
    for i, w in enumerate(m):
        same = [k for k in range(len(m)) if (m[k] == w).all()]
        assert (node[i] < 0) == (len(same) == 1)
        if len(same) > 1:
            assert least[node[i]] == first[tuple(w)] and least[head[node[i]]] == first[tuple(w)]
    assert depth.max() == 25 and set(depth[head[node[node >= 0]]].tolist()) == {25, 17, 22}  # 25 words in all four, then 13 + 4 in three, 13 + 9 in two


def test_suffix_dedup(docs, plain):
    count = {}
    raw = [(i, x.encode()) for i, x in plain]
    for _, x in raw:
        for k in range(len(x) - 199):
            count[x[k : k + 200]] = count.get(x[k : k + 200], 0) + 1
    want = []
    for i, x in raw:
        cover = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - 199):
            if count[x[k : k + 200]] > 1:
                cover[k : k + 200] = True
        edges = int(np.count_nonzero(np.diff(np.concatenate(([0], cover.astype(int)))) == 1))
        want.append((i, len(x), int(cover.sum()), edges, sha(np.frombuffer(x, np.uint8)[~cover[:-1]].tobytes())))
    assert by_row(suffix_dedup.digest(docs).collect(), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix_dedup.digest(docs.limit(0)).count() == 0


def test_merge_of_front_coded_runs():
    r = random.Random(5)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 40))) for _ in range(7)]
    coded = [suffix_dedup.front_coded(x) for x in runs]
    assert [suffix_dedup.decoded(*c) for c in coded] == runs
    order, place, prefix = suffix_dedup.merged(runs, [c[0].tolist() for c in coded])
    out = [runs[a][b] for a, b in zip(order, place, strict=True)]
    assert out == sorted(x for y in runs for x in y)
    assert prefix[1:] == [suffix_dedup.common(a, b) for a, b in zip(out, out[1:], strict=False)]


def test_fingerprints(docs, plain):
    got = fingerprints.digest(docs).collect()
    assert len(got) == len(plain) and fingerprints.digest(docs.limit(0)).count() == 0
    ids = [i for i, _ in plain]
    order = sorted(((i, x) for i, x in plain if ids.count(i) == 1), key=lambda p: first(p[0]))
    rows = {r["doc_id"]: r for r in got}
    ranked = sorted(plain, key=lambda p: first(p[0]))
    for i, x in order:
        after = ranked[(ranked.index((i, x)) + 1) % len(ranked)][1]
        m = len(x) // 4
        assert rows[i]["edited_sha256"] == sha(x[: len(x) - m] + after[:m]) and rows[i]["n_chars"] == len(x)
        a, b = (shingles(y.lower()) for y in (x, x[: len(x) - m] + after[:m]))
        if min(len(a), len(b)) > 20:
            assert abs(rows[i]["near_edited"] - len(a & b) / len(a | b)) < 0.15
    same = {}
    for r in got:
        same.setdefault(dict(plain)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def plain_fingerprint(x):
    """One-permutation MinHash of one text, bin by bin."""
    ws = words_of(x.lower())
    grams = [ws[k : k + 5] for k in range(len(ws) - 4)] if len(ws) >= 5 else ([[" ".join(ws)]] if ws else [])
    bins = {}
    for g in grams:
        h = 42
        for w in g:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        b = h >> 56
        key = h - 2**64 if h >= 2**63 else h  # as signed numbers
        bins[b] = min(bins.get(b, 2**63), key)
    if not bins:
        return ""
    # Bins are turned by half, as signed numbers order them.
    bins = {(b + 128) % 256: k & 15 for b, k in bins.items()}
    probe = lambda i, j: xxhash.xxh64_intdigest(struct.pack("<i", j), xxhash.xxh64_intdigest(struct.pack("<i", i), 42))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    out = []
    for i in range(256):
        at = next((probe(i, j) % 256 for j in range(1, 25) if probe(i, j) % 256 in bins), None) if i not in bins else i
        out.append(bins[at] if at is not None else bins[min(bins, key=lambda b, i=i: signed(probe(i, b)))])
    return "".join(f"{d:X}" for d in out)


def plain_likeness(a, b):
    if not a or not b or a == b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def test_fingerprints_by_hand(docs, plain):
    """Every fingerprint and likeness against plain Python; the next document by id, unique ids alone."""
    ids = [i for i, _ in plain]
    rows = {r["doc_id"]: r for r in fingerprints.digest(docs).collect()}
    ranked = sorted(plain, key=lambda p: first(p[0]))
    prints = {x: plain_fingerprint(x) for _, x in plain}
    for k, (i, x) in enumerate(ranked):
        after = ranked[(k + 1) % len(ranked)][1]
        if ids.count(i) == 1:
            m = len(x) // 4
            e = plain_fingerprint(x[: len(x) - m] + after[:m])
            r = rows[i]
            assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[x], e), i
            assert r["near_edited"] == pytest.approx(plain_likeness(prints[x], e)) and r["near_next"] == pytest.approx(plain_likeness(prints[x], prints[after]))


def test_fingerprints_over_many_ranges(spark):
    rows = [(7 * k % 101, prose(12)) for k in range(101)]
    x = {r["doc_id"]: r for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows_a_range=3).collect()}
    text = dict(rows)
    assert all(x[k]["next_text"] == text[(k + 1) % 101] for k in range(101))


def shingles(x):
    w = words_of(x)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def component_ids(rows):
    sets = [shingles(re.sub("[A-Z]", lambda m: m[0].lower(), x)) for _, x in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [j for m, (j, _) in enumerate(rows) if find(m) == find(k) and j is not None]
        out.append((i, len(sets[k]), min(known) if known else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("region", [8000, 4])
def test_jaccard_join(spark, docs, plain, region):
    r = random.Random(8)
    base = [prose(40, r) for _ in range(3)]
    rows = list(plain)
    for k in range(60):
        w = base[k % 3].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((1000 + k, " ".join(w)))
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), region)
    assert by_row(got.collect(), "doc_id", "n_shingles", "component_id") == component_ids(rows)
    assert jaccard_join.digest(docs.limit(0)).count() == 0


def test_near_duplicates_by_row(spark):
    r = random.Random(12)
    a, b, c, d, e = (prose(60, r) for _ in range(5))
    rows = [(4, a), (None, a + " tail"), (None, prose(50, r)), (None, prose(50, r)), (None, b), (None, b + " tail"), (None, b + " more"), (7, c), (7, prose(50, r)), (3, c + " tail"), (8, d), (8, d + " tail"), (9, e), (None, None), (None, "")]
    got = {(x["doc_id"], x["text"]) for x in jaccard_join.stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {rows[k] for k in (0, 2, 3, 8, 9, 12, 13, 14)} <= got and not {rows[k] for k in (1, 7)} & got
    assert sum(i is None and (x or "").startswith(b) for i, x in got) == 1 and sum(i == 8 for i, _ in got) == 1 and len(got) == 10


def test_region_recursion():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        b = r.choice(5000, 60, replace=False)
        for _ in range(5):
            s = b.copy()
            s[r.integers(0, 60, r.integers(0, 14))] = r.integers(5000, 9000)
            sets.append(np.unique(s))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard_join.near(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))]
    got = jaccard_join.region_links(sets, list(range(len(sets))), leaf=6)
    assert {(max(p), min(p)) for p in got} <= set(pairs)

    def groups(edges):
        up = list(range(len(sets)))
        for a, b in edges:
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        return [up.index(u) for u in up]

    assert groups(got) == groups(pairs)


def test_cells_keep_every_link(spark):
    """Of a large family every linked pair meets in a cell, or in what cells cannot part; cells are small."""
    r = np.random.default_rng(9)
    common, sets = r.choice(400, 60, replace=False), []
    for _ in range(30):
        b = np.concatenate((r.choice(common, r.integers(0, 50), replace=False), r.choice(400, 40)))
        for _ in range(4):
            s = b.copy()
            s[r.integers(0, len(s), r.integers(0, 8))] = r.integers(400, 9000)
            sets.append(np.unique(s))
    pairs = {(a, b) for a in range(len(sets)) for b in range(a) if jaccard_join.near(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))}
    nodes = spark.createDataFrame([(f"{k:03}", len(s), s.tolist()) for k, s in enumerate(sets)], "node string, n long, shingles array<long>")
    cells, stubborn, links = jaccard_join.cut_into_cells(nodes.selectExpr("'f' AS g", "node", "node AS label"), nodes, 40)
    groups = {}
    for kind, df in (("cell", cells), ("stubborn", stubborn)):
        for x in df.collect():
            groups.setdefault((kind, x["g"]), set()).add(int(x["node"]))
    assert pairs and all(any({a, b} <= g for g in groups.values()) for a, b in pairs)
    assert sum(k == "cell" for k, _ in groups) > 3 and all(len(g) <= 40 for (k, _), g in groups.items() if k == "cell")
    assert all((max(p), min(p)) in pairs for p in ((int(x["a"]), int(x["b"])) for x in links.collect()))


@pytest.mark.parametrize("sent", [100, 0])
def test_components(spark, sent):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)] + [("x1", "x2")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a string, b string"), sent).collect()}
    assert all(v == ("x1" if k[0] == "x" else "n000") for k, v in got.items()) and len(got) == 33


def test_decontamination(spark, docs):
    items = [(1, "Anna bought 12 apples for 30 cents and gave 12 of the apples to her brother Peter yesterday"), (2, None), (3, "too short now"), (4, prose(25)), (5, "seven plain words stand here all alone")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    again = "before this Bob bought 7 apples for 45 cents and gave 7 of the apples to her brother Carl yesterday and more"
    mixed = "before this Bob bought 7 apples for 45 cents and gave 9 of the apples to her brother Carl yesterday and more"
    rows = [(1, again), (2, mixed), (3, prose(10) + " " + items[3][1] + " " + prose(9)), (4, prose(50)), (5, None), (6, "so seven plain words stand here all alone again"), (None, items[0][1])]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10_000, 0):
        got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.leaks(x, asked, most).collect()}
        assert got == {(1, 1, True), (3, 4, False), (6, 5, False), (None, 1, False)}
    assert {r["doc_id"] for r in decontaminate.stage(x, asked).collect()} == {2, 4, 5}
    assert decontaminate.leaks(x, asked.limit(0)).count() == 0 and decontaminate.leaks(x.limit(0), asked).count() == 0


def test_decontamination_after_any_word(spark):
    items = [(1, "What is the capital of France and who built it?"), (2, "Minutes later the old train left us all behind there"), (3, "we all know that Peter walks slowly home through the old wet garden every day")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "Question: " + items[0][1]), (2, "A heading\n" + items[0][1]), (3, items[0][1]), (4, "it took 5 " + items[1][1]), (5, "Peter walks slowly home through the old wet garden every"), (6, "Question: Who is the capital of France and who built it?")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10_000, 0):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(x, asked, most).collect()} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)}


def test_decontamination_of_few_plain_words(spark):
    codes = " ".join(f"{k} Anna Bob" for k in range(10, 17))
    items = [(1, "What is 12 times 7?"), (2, "Did Anna Smith meet Bob Jones?"), (3, codes), (4, "Is 4 even?"), (5, "..."), (6, None), (7, "how many of the 9 birds flew")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"so it says: {x} and {prose(9)}") for k, x in items[:4]] + [(5, "What is 13 times 7?"), (6, prose(5) + " ... " + prose(6)), (7, "how many of the 8 birds flew"), (8, "did anna smith meet bob jones")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10_000, 0):
        got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.leaks(x, asked, most).collect()}
        assert got == {(1, 1, False), (2, 2, False), (3, 3, False), (4, 4, False), (7, 7, True), (8, 2, False)}


def test_decontamination_keeps_verbatim_windows_and_rows_apart(spark):
    head = "every farmer on the hill keeps 12 brown goats behind the old stone barn near the river and feeds them all at dawn"
    items = [(1, f"{head} before the other 12 go out"), (2, "we saw that Peter had bought 8 green apples at the small market"), (None, prose(15)), (None, "some say that Carla had sold 5 old books at the long fair")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    again = "we saw that {} had bought {} green apples at the small market"
    rows = [(1, f"{head} before the other 9 go out"), (None, again.format("Paul", 3)), (None, again.format("Mary", 4)), (7, again.format("John", 5)), (7, again.format("Jane", 6)), (8, items[2][1]), (9, "some say that Frank had sold 6 old books at the long fair")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10_000, 0):
        got = [(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.leaks(x, asked, most).collect()]
        assert sorted(got, key=repr) == sorted([(1, 1, False), (None, 2, True), (None, 2, True), (7, 2, True), (7, 2, True), (8, None, False), (9, None, True)], key=repr)


def test_decontamination_of_glued_units_and_number_words(spark):
    items = [(1, "the tall farmer carried 12kg of apples over the hill to market"), (2, "she had twelve small cats that slept on the warm stone wall")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[0][1]), (2, items[0][1].replace("12kg", "15 kg")), (3, items[0][1].replace("12kg", "7.5lb.")), (4, items[1][1].replace("twelve", "thirteen")), (5, items[1][1].replace("twelve", "40")), (6, items[1][1].replace("twelve", "many"))]
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), asked).collect()}
    assert got == {(1, 1, False), (2, 1, True), (3, 1, True), (4, 2, True), (5, 2, True)}


def test_decontamination_of_a_common_preamble(spark):
    head = prose(12)
    items = [(k, f"{head} {prose(14)}") for k in range(40)]
    rows = [(k, f"{prose(5)} {head} {prose(5)}") for k in range(30)] + [(100, items[7][1]), (101, prose(40)), (102, " ".join(items[9][1].split()[12:]))]
    for most in (10_000, 0):
        got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most).collect()
        assert {r["doc_id"] for r in got} == {*range(30), 100, 102} and len(got) < 60  # not 30 x 40
        assert {(100, 7), (102, 9)} <= {(r["doc_id"], r["item_id"]) for r in got}


def test_decontamination_recall(spark):
    """Planted verbatim and re-parameterised items among other text: all are found, nothing else is."""
    r = random.Random(21)
    names = ["Anna", "Peter", "Clara", "Hugo", "Nina", "Oskar"]

    def item(k):
        w = prose(r.randint(12, 30), r).split()
        for _ in range(3):
            w[r.randrange(1, len(w))] = r.choice([str(r.randint(2, 999)), r.choice(names)])
        return " ".join(w)

    def changed(x):
        maps = {}
        return " ".join(maps.setdefault(w, str(len(maps) + 1000)) if w.isdigit() else maps.setdefault(w, f"Name{chr(97 + len(maps))}") if w in names else w for w in x.split())

    items = [(k, item(k)) for k in range(60)]
    rows = [(k, f"{prose(20, r)} {x} {prose(20, r)}") for k, x in items] + [(100 + k, f"{prose(20, r)} {changed(x)} {prose(20, r)}") for k, x in items] + [(200 + k, prose(80, r)) for k in range(60)]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len({k for k in range(60) if (k, k) in got}) == 60 and len({k for k in range(60) if (100 + k, k) in got}) >= 57 and not {d for d, _ in got if d >= 200}


def test_decontamination_of_one_template(spark):
    """A copy of any of twenty items of one template is found, the least of which fills two slots alike; so are other fillings, of one kind or the other."""
    head = "please compute how much {} plus then {} equals in total today {}"
    items = [(k, head.format(5 if k == 0 else 10 + k, 5 if k == 0 else 40 + k, "")) for k in range(20)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"{prose(9)} so {items[5][1]} {prose(7)}"), (2, head.format(98, 99, prose(5))), (3, head.format(98, 98, prose(5))), (4, head.replace("plus", "minus").format(12, 42, ""))]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10_000, 0):
        for shared in (16, 1):
            got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.leaks(x, asked, most, shared).collect()}
            assert (1, 5, False) in got and {d for d, _, _ in got} == {1, 2, 3}
            assert {(i, p) for d, i, p in got if d == 2} == {(1, True)} and {(i, p) for d, i, p in got if d == 3} == {(0, True)}


def test_decontamination_of_repeated_windows(spark):
    items = [(1, "spam " * 600), (2, "give 7 red balls to the boy near the door and " * 40)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    x = spark.createDataFrame([(1, items[0][1]), (2, items[1][1].replace("7", "9")), (3, "spam " * 9)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(x, asked).collect()}
    assert set(got) == {1, 2} and got[1]["n_windows"] == 1 and got[2]["n_windows"] <= 11 and got[2]["reparameterised"]


def plain_leaks(rows, items):
    """Documents that hold a window of an item, verbatim, or consistently over an alignment: all windows of all pairs."""

    def windows(x, length):
        t = decontaminate.templates([x])
        _, pos, h, own = decontaminate.windows(t, length)
        return [(p, y, tuple(t["bare"][t["codes"][k]].lower() for k in range(p + a, p + length) if t["kind"][k])) for p, y, a in zip(pos.tolist(), h.tolist(), own.tolist(), strict=True)]

    by_length = {}
    for i, x in items:
        if any(w.strip(decontaminate._STRIP) for w in (x or "").split()):
            length = min(decontaminate.WINDOW, decontaminate.templates([x])["n"][0])
            for p, h, slots in windows(x, int(length)):
                by_length.setdefault(int(length), {}).setdefault(h, []).append((i, p, slots))
    found = {}
    for d, y in rows:
        lines = {}
        for length, mine in by_length.items():
            for dp, h, filled in windows(y, length):
                for i, ip, slots in mine.get(h, ()):
                    if len(slots) == len(filled):
                        lines.setdefault((i, dp - ip), []).append((slots, filled))
        for (i, _), pairs in lines.items():
            fill = {p for s, f in pairs for p in zip(s, f, strict=True)}
            if any(s == f for s, f in pairs) or len(fill) == len({b for b, _ in fill}) == len({c for _, c in fill}):
                found.setdefault(d, set()).add(i)
    return found


def test_decontamination_equals_all_pairs(spark):
    """Documents with leaks are those that a comparison of all windows of all pairs finds; items of few templates, with slots that agree or not."""
    r = random.Random(77)
    shapes = [prose(r.randint(9, 16), r).split() for _ in range(4)]

    def filled(w):
        w = list(w)
        for k in (2, 5, 7):
            w[k] = r.choice(["3", "4", "Anna", "Bob"])
        return " ".join(w)

    items = [(k, filled(r.choice(shapes))) for k in range(50)]
    rows = []
    for k in range(150):
        w = filled(r.choice(shapes)).split()
        if k % 3 == 0:
            w[r.randrange(len(w))] = r.choice(["zzz", "9", "Carl"])
        rows.append((k, f"{prose(4, r)} {' '.join(w[r.randint(0, 2):])} {prose(3, r)}"))
    want = plain_leaks(rows, items)
    x, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for y in decontaminate.leaks(x, asked).collect():
        got.setdefault(y["doc_id"], set()).add(y["item_id"])
    assert 20 < len(want) < 150 and set(got) == set(want) and all(got[d] <= want[d] for d in got)


def test_decontamination_stage_by_row(spark):
    item, clean = prose(20), [prose(30) for _ in range(4)]
    rows = [(None, f"so {item} it is"), (None, clean[0]), (None, None), (5, f"and {item} again"), (5, clean[1]), (6, clean[2])]
    got = decontaminate.stage(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[k] for k in (1, 2, 4, 5)], key=repr) and got.columns == ["doc_id", "text"]


def plain_topics(rows):
    """Topic of each (text, language), as the docstring of mixing says."""
    split = [[w for w in re.split(mixing.BETWEEN, x or "") if 4 <= len(w) <= 32] for x, _ in rows]
    best = {}
    for lang in {y or "" for _, y in rows}:
        own = [set(ws) for ws, (_, y) in zip(split, rows, strict=True) if (y or "") == lang]
        total = {w: sum(w in ws for ws in own) for w in set().union(*own)}
        best[lang] = sorted((w for w, d in total.items() if d >= 2 and d * 10 <= len(own)), key=lambda w, t=total: (-t[w], w))[: mixing.TOPICS]
    out = []
    for ws, (_, y) in zip(split, rows, strict=True):
        b = best[y or ""]
        out.append(f"topic {1 + max(range(len(b)), key=lambda k, ws=ws, b=b: (ws.count(b[k]), -k))}" if set(b) & set(ws) else "other")
    return out


def test_topics(spark):
    r = random.Random(31)
    rows = [(k, prose(6, r), ["en", "de", None][k % 3]) for k in range(150)] + [(None, None, "en"), (7, "", None)]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mixing.with_topic(x, mixing.topic_words(x), "topic").collect()
    want = zip((i for i, _, _ in rows), (t for _, t, _ in rows), plain_topics([(t, y) for _, t, y in rows]), strict=True)
    assert sorted((tuple(g[c] for c in ("doc_id", "text", "topic")) for g in got), key=repr) == sorted(want, key=repr) and len({g["topic"] for g in got}) > 5


def test_mixing(docs, plain):
    got = mixing.digest(docs).collect()
    assert len(got) == len(plain) and all(0 <= r["p"] <= 1 for r in got)
    total = sum(r["n_tokens"] for r in got)
    assert total == sum(len(words_of(x)) for _, x in plain)
    assert sum(r["n_tokens"] * r["p"] for r in got) <= total * mixing.BUDGET * 1.01
    assert mixing.digest(docs.limit(0)).count() == 0
    odd = mixing.stage(docs.withColumnRenamed("batch", "mix_p").withColumnRenamed("node", "mix_topic"))
    assert sorted(first(r["doc_id"]) for r in odd.collect()) == sorted(first(r["doc_id"]) for r in got if r["selected"])
    assert odd.columns.count("mix_p") == 1 and "row" in odd.columns


def plain_raking(cells, targets):
    w = {k: float(n) for k, n in cells.items()}
    for _ in range(500):
        for d, t in enumerate(targets):
            m = {v: sum(x for k, x in w.items() if k[d] == v) for v in t}
            w = {k: x * t[k[d]] / m[k[d]] for k, x in w.items()}
    return w


def test_raking_meets_marginals(spark):
    cells = {(s, x, t): (i + 1) * 10 + j * 7 + k * 3 for i, s in enumerate("abc") for j, x in enumerate(("en", "de")) for k, t in enumerate("pq") if (i, j) != (2, 1)}
    table = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"en": 0.7, "de": 0.3}, {"p": 0.6, "q": 0.4}]
    rows = mixing.rake(table, {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in zip(mixing.DIMENSIONS, targets, strict=True)}).collect()
    want = plain_raking(cells, targets)
    assert all(r["w"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], abs=1e-5) and r["error"] <= mixing.TOLERANCE for r in rows)
    # Targets that the cells cannot meet: the error says so.
    odd = [{"a": 0.2, "b": 0.2, "c": 0.6}, {"en": 0.1, "de": 0.9}, {"p": 0.6, "q": 0.4}]
    rows = mixing.rake(table, {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in zip(mixing.DIMENSIONS, odd, strict=True)}, patience=1).collect()
    assert all(r["error"] > 0.01 for r in rows)


def test_warc(spark):
    html = [None, "", "<p>é</p>", "x" * 700_000, "<p>é</p>", "same", "same", ""]
    pages = spark.createDataFrame([(i if i != 6 else None, "http://a/\r\nb", h, "e") for i, h in enumerate(html)], "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in warc.digest(pages).collect()}
    for i, h in enumerate(html):
        r = got[i if i != 6 else None]
        raw = (h or "").encode()
        kin = [j for j, x in enumerate(html) if (x or "").encode() == raw and j != 6]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc.digest_of(raw)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if min(kin) == i else ("revisit", min(kin)))
    assert warc.digest(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.digest(twice).collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert {r["kind"] for r in warc.decided(pages, min_bytes=10_000_000).collect()} == {"response"}


def test_normaliser_round_trip():
    whole = [warc.record("response", i, "u", bytes([65 + i]) * (i * 90_000), "D", None) for i in range(5)]
    source = io.BytesIO()
    assert warc.write_archive(source, iter(whole)) == 5
    source.seek(0)
    out, index = io.BytesIO(), io.BytesIO()
    places = list(warc.normalise(source, out, index))
    assert [gzip.decompress(out.getvalue()[a : a + n]) for a, n in places] == whole
    assert gzip.decompress(out.getvalue()) == b"".join(whole) and len(index.getvalue().splitlines()) == 5
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(whole[1][:-9]))))
    for cut in (1, 8, 2000):  # without its trailer or within the last member
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(source.getvalue()[:-cut])))
    assert list(warc.read_index(index.getvalue())) == [(a, n, "<urn:page:" + str(i) + ">", "response") for i, (a, n) in enumerate(places)]


def numeric(loss, p, k, i, e=1e-4):
    kept = p[k][i]
    p[k][i] = kept + e
    a = loss()
    p[k][i] = kept - e
    b = loss()
    p[k][i] = kept
    return (a - b) / (2 * e)


def test_quality_gradients_and_learning(spark, docs):
    p = {k: v.astype(np.float64) for k, v in quality.start().items()}
    parts = quality.encoded([prose(80), prose(3), "", prose(40).upper()])
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        s = quality._forward(quality._means(*parts[:3], p).astype(np.float64), parts[3], p)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    got = quality.gradients(*parts, y, w, p)
    for k in ("a", "v", "u", "w1", "c", "d"):
        i = tuple(np.unravel_index(np.abs(got[k]).argmax(), got[k].shape))
        assert numeric(loss, p, k, i, 1e-3) == pytest.approx(got[k][i], rel=0.05, abs=1e-5)
    r = random.Random(1)
    good, bad = [prose(60, r) for _ in range(80)], [" ".join(f"{w}!!" for w in prose(60, r).upper().split()) for _ in range(80)]
    m = quality.fit([quality.passages_of(x) for x in good[:60] + bad[:60]], [1] * 60 + [0] * 60)
    s = quality.scores(good[60:] + bad[60:], m)
    assert s[:20].min() > s[20:].max()
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    assert quality.digest(docs, labels).count() == docs.count() and quality.digest(docs.limit(0), labels).count() == 0
    assert quality.stage(docs, labels).columns == docs.columns
    assert quality.stage(docs.withColumnRenamed("node", "_ql_score"), labels).count() == docs.count()


def plain_score(x, p):
    """The score of one text, passage by passage."""
    data = np.frombuffer(x.encode("utf-8", "replace") + b" ", np.uint8)
    _, shape, word = quality.word_codes(data)
    h, e = [], []
    for k in range(0, max(1, len(shape)), quality.PASSAGE):
        a, b = shape[k : k + quality.PASSAGE], word[k : k + quality.PASSAGE]
        mean = np.concatenate((p["shape"][a].mean(0), p["word"][b].mean(0))) if len(a) else np.zeros(2 * quality.DIM)
        h.append(np.tanh(mean @ p["w1"] + p["b1"]))
        e.append((np.tanh(h[-1] @ p["v"]) / (1 + np.exp(-(h[-1] @ p["u"])))) @ p["a"])
    w = np.exp(np.array(e) - max(e))
    return 1 / (1 + np.exp(-((w / w.sum()) @ np.array(h) @ p["c"] + p["d"][0])))


def test_quality_scores_by_hand(plain):
    p = quality.start(3)
    p["b1"] += 0.2
    texts = [x for _, x in plain] + [prose(60_000)]
    assert quality.scores(texts, p) == pytest.approx([plain_score(x, p) for x in texts], abs=1e-4)


def test_sample_of_least_hashes(spark):
    rows = [(k, "a" if k % 10 else "b") for k in range(3000)] * 2 + [(5, "c")]
    got = least_hashed(spark.createDataFrame(rows, "doc_id long, kind string"), "kind", 40)
    assert got.groupby("kind").size().to_dict() == {"a": 40, "b": 40, "c": 1} and not got.duplicated().any()
    hot = spark.range(60_000).selectExpr("7L AS doc_id", "'a' AS kind").union(spark.range(100, 498).selectExpr("id", "'a'"))
    assert len(least_hashed(hot, "kind", 150)) == 150


def test_quality_and_language_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["score"], known[r["doc_id"]], r["predicted"]) for r in quality.digest(docs, labels).collect() if r["held_out"] and known.get(r["doc_id"]) is not None]
    good, bad = [s for s, q, _ in rows if q], [s for s, q, _ in rows if not q]
    assert bad and sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.85
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in language.digest(docs).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) > 0.95 * len(rows)


def test_language_gradients_and_prediction(spark, docs):
    p = {k: v.astype(np.float64) for k, v in language.start(3).items()}
    lanes = np.random.default_rng(0).integers(0, 257, (4, language.STEPS)).astype(np.int16)
    y = np.array([0, 1, 2, 1])
    used = (lanes.T != 256)[:, :, None]

    def loss():
        q = language.position_probabilities(language.forward(lanes, p), p)
        return -(np.log(q[:, np.arange(4), y])[:, :, None] * used).sum() / used.sum()

    got = language.gradients(lanes, y, p)
    for k in p:
        i = tuple(np.unravel_index(np.abs(got[k]).argmax(), got[k].shape))
        assert numeric(loss, p, k, i, 1e-3) == pytest.approx(got[k][i], rel=0.05, abs=1e-5)
    r = random.Random(2)
    make = lambda s: " ".join("".join(r.choice(s) for _ in range(5)) for _ in range(60))
    m = language.fit([language.some_segments(make(s)) for s in ["abcd"] * 40 + ["wxyz"] * 40], ["aa"] * 40 + ["zz"] * 40)
    texts = [make("abcd"), make("wxyz"), None, "123 !", "", "²½ ① Ⅷ", "ª", prose(9)]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identified(x, m).collect()}
    assert [got[k]["_lang"] for k in range(6)] == ["aa", "zz", "und", "und", "und", "und"] and got[6]["_lang"] != "und"
    for k in (0, 1, 7):  # one text alone, all positions
        lanes, _ = language.segments([texts[k].encode()])
        y = language.position_probabilities(language.forward(lanes, m), m)[lanes.T != 256].mean(0)
        assert got[k]["_score"] == pytest.approx(float(y.max()), abs=1e-5) and got[k]["_lang"] == m["names"][y.argmax()]
    rows = language.digest(docs).collect()
    assert len(rows) == docs.count() and all(0 <= x["score"] <= 1 for x in rows) and language.digest(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage's rows are those that a plain version, or the operator's own scores and draws, leave of its input."""
    d = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_filter", "line_dedup", "near_duplicates", "benchmark_decontamination", "source_mixing"]
    at = docs
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, at, d).cache()
        assert 0 < out.count() <= at.count(), name
        if k < 4:
            assert out.columns == docs.columns
        rows = [(r["doc_id"], r["text"] or "") for r in at.collect()]
        got = {r["doc_id"]: r["text"] or "" for r in out.collect()}
        if name == "quality_filter":
            want = {r["doc_id"] for r in quality.digest(at, labels).collect() if r["predicted"]}
        elif name == "line_dedup":
            kept = {i: "\n".join(s for n, s in enumerate(lines) if n not in gone) for (i, _), (lines, gone) in plain_line_dedup(rows).items() if len(gone) < len(lines)}
            want = set(kept)
            assert got == kept
        elif name == "near_duplicates":
            want = {i for i, _, c in component_ids(rows) if c == i}
        elif name == "benchmark_decontamination":
            want = {i for i, _ in rows} - set(plain_leaks(rows, [(r["item_id"], r["text"]) for r in items.collect()]))
        else:
            want = {r["doc_id"] for r in mixing.digest(at).collect() if r["selected"]}
        assert set(got) == want, name
        at = out


def test_pipeline_of_odd_rows(spark, docs):
    """Null and repeated ids, null and empty texts, ties and repeated rows pass through all stages; an empty table stays empty."""
    d = "/root/testdata/sf0.001"
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    same = own.filter("doc_id > 20 AND doc_id < 40").withColumn("doc_id", F.lit(7).cast("long"))
    at, none = own.unionByName(same).unionByName(own.filter("doc_id > 40").withColumn("doc_id", F.lit(None).cast("long"))), own.limit(0)
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        # The classifier may reject everything that this table of noise holds: the other stages then get the whole table.
        out = f(spark, at, d).cache()
        assert out.count() <= at.count() and (k == 4 or out.columns == own.columns), name
        none = f(spark, none, d)
        assert none.count() == 0, name
        at = out if k and k < 4 and out.count() else at
        none = spark.createDataFrame([], own.schema)
