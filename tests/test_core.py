"""Hand-computed cases of the process-log engine."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracework import log as L
from tracework.functions.scalar import HOUR, ensure_fractional_seconds, micros, safe_name
from tracework.operators import aggregates as A
from tracework.operators import assess as B
from tracework.operators import cuts as C
from tracework.operators import distances as D
from tracework.operators import experiment as X
from tracework.operators import ranking as R
from tracework.operators import snapshot as P
from tracework.operators import sweep as M
from tracework.operators import transforms as T
from tracework.operators import windows as W
from tracework.operators.running import numbered, running
from tracework.plans import catalog

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, case_id string, activity string, resource string, start_time timestamp, end_time timestamp"


def at(hours):
    return DAY + timedelta(hours=hours)


def us(hours):
    return int(at(hours).timestamp()) * 1_000_000


def log(spark, *rows):
    return spark.createDataFrame([(i, c, a, r, at(s), None if t is None else at(t)) for i, (c, a, s, t, r) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def pair(spark):
    return log(spark, ("c1", "A", 10, 12, "R1"), ("c1", "B", 12, 13, "R2")), log(spark, ("c1", "A", 10, 12, "R1"), ("c1", "C", 12, 13, "R2"))


def one(df, **where):
    rows = [r.asDict() for r in df.collect()]
    return next(r for r in rows if all(r[k] == v for k, v in where.items()))


def test_diverging_activity(pair):
    d = M.state_distances(*pair, ["activity"])
    assert one(d, distance="jaccard")["summary_distance"] == pytest.approx(1 / 3)
    assert one(d, distance="jaccard")["total_duration_seconds"] == 10800
    assert one(d, distance="cardinality")["summary_distance"] == 0


def test_identity_and_window(pair):
    a, b = pair
    assert all(r["summary_distance"] == 0 for r in M.state_distances(a, a, ["activity", "case"]).collect())
    got = one(M.state_distances(a, b, ["activity"], window=(us(9), us(15))), distance="jaccard")
    assert got["summary_distance"] == pytest.approx(1 / 6) and got["total_duration_seconds"] == 21600
    with pytest.raises(ValueError):
        M.state_distances(a, b, ["activity"], window=(us(9), us(9)))


def test_disjoint_empty_and_zero_length(spark):
    a, b = log(spark, ("c1", "A", 10, 11, "R")), log(spark, ("c2", "B", 12, 13, "R"))
    assert one(M.state_distances(a, b, ["activity"]), distance="jaccard")["summary_distance"] == pytest.approx(2 / 3)
    got = one(M.state_distances(a, a.limit(0), ["activity"]), distance="jaccard")
    assert got["summary_distance"] == 1 and got["total_duration_seconds"] == 3600
    assert M.steps(M.keyed_steps(M.instances(log(spark, ("c", "Z", 10, 10, "R"), ("c", "A", 11, 12, "R")), a.limit(0), ["activity"]))).count() == 2


def random_pair(spark, n=40):
    r = random.Random(17)
    out = []
    for _ in range(2):
        starts = [r.randint(0, 40) for _ in range(n)]
        out.append([(f"c{r.randint(0, 5)}", r.choice("ABC"), s, s + r.randint(0, 9), f"R{r.randint(0, 2)}") for s in starts])
    return out, [log(spark, *x) for x in out]


def active(rows, t, key):
    return Counter(key(x) for x in rows if x[2] <= t < x[3])


def test_state_distances_by_definition(spark):
    """Every boundary's multisets, built one by one."""
    (a, b), logs = random_pair(spark)
    got = {(r["view"], r["distance"]): r["summary_distance"] for r in M.state_distances(*logs, ["activity", "case", "activity_case"]).collect()}
    times = sorted({t for x in a + b if x[3] > x[2] for t in x[2:4]})
    for view, key in (("activity", lambda x: x[1]), ("case", lambda x: x[0]), ("activity_case", lambda x: (x[1], x[0]))):
        jaccard = cardinality = 0.0
        for t, u in zip(times, times[1:], strict=False):
            x, y = active(a, t, key), active(b, t, key)
            most, n, m = sum((x | y).values()), sum(x.values()), sum(y.values())
            jaccard += (u - t) * (1 - sum((x & y).values()) / most if most else 0)
            cardinality += (u - t) * (abs(n - m) / max(n, m) if max(n, m) else 0)
        assert got[view, "jaccard"] == pytest.approx(jaccard / (times[-1] - times[0])) and got[view, "cardinality"] == pytest.approx(cardinality / (times[-1] - times[0]))


def test_assessment_by_definition(spark):
    """Scores, contributions and each interval's contributors from multisets built one by one; waiting times filled within the case."""
    (a, b), logs = random_pair(spark)
    found = B.assess(*logs, views=["activity", "activity_phase"], top=2)
    good = [[x for x in rows if x[3] > x[2]] for rows in (a, b)]
    assert {r["log"]: (r["valid"], r["invalid"]) for r in found["meta"].collect()} == {k: (len(g), 40 - len(g)) for k, g in zip("ab", good, strict=True)}

    def phases(rows):
        out, order = [], sorted(range(len(rows)), key=lambda i: (rows[i][2], rows[i][3], i))
        for n, i in enumerate(order):
            c, act, s, t, r = rows[i]
            out.append((c, (act, "processing"), s, t, r))
            before = [rows[j][3] for j in order[:n] if rows[j][0] == c]
            if before and before[-1] < s:
                out.append((c, (act, "waiting"), before[-1], s, r))
        return out

    score = {r["view"]: r["overall_score"] for r in found["scores"].collect()}
    parts = {(r["view"], tuple(r["key"])): r["contribution"] for r in found["contributors"].collect()}
    best = {(r["view"], r["start"], r["rank"]): (tuple(r["key"]), r["share"]) for r in found["intervals"].collect()}
    zero = DAY.timestamp()
    for view, key, (x, y) in (("activity", lambda e: (e[1],), good), ("activity_phase", lambda e: e[1], [phases(g) for g in good])):
        times = sorted({t for e in x + y for t in e[2:4]})
        area, by, want = 0.0, Counter(), {}
        for t, u in zip(times, times[1:], strict=False):
            p, q = active(x, t, key), active(y, t, key)
            total = sum(p.values()) + sum(q.values())
            apart = {k: abs(p[k] - q[k]) for k in p | q if p[k] != q[k]}
            area += (u - t) * 3600 * (sum(apart.values()) / total if total else 0)
            for k, v in apart.items():
                by[k] += (u - t) * 3600 * v / total
            for rank, k in enumerate(sorted(apart, key=lambda k: (-apart[k], k))[:2]):
                want[view, zero + 3600 * t, rank + 1] = (k, pytest.approx(apart[k] / total))
        assert score[view] == pytest.approx(area / (times[-1] - times[0]) / 3600)
        assert {k[1]: v for k, v in parts.items() if k[0] == view} == {k: pytest.approx(v) for k, v in by.items()}
        assert {k: v for k, v in best.items() if k[0] == view} == want


def test_concurrency_by_definition(spark):
    """Shares of overlapping pairs and the last end before a start, from all pairs of a case."""
    (a, _), (one_log, _) = random_pair(spark)
    over, last = {}, {}
    for i, x in enumerate(a):
        for j, y in enumerate(a):
            if i != j and x[0] == y[0]:
                if x[1] != y[1]:
                    over.setdefault((x[1], y[1]), []).append(x[2] < y[3] and y[2] < x[3])
                if y[3] <= x[2]:
                    last[i, y[1]] = max(y[3], last.get((i, y[1]), -1))
    for share in (0.1, 0.2, 0.3, 0.5):
        assert {tuple(r) for r in P.concurrent_pairs(one_log, share).collect()} == {k for k, v in over.items() if sum(v) / len(v) >= share}
    assert {(r["id"], r["b"]): (r["last"] - us(0)) // HOUR for r in P.ends_before(one_log).collect() if r["last"] is not None} == last


def test_metric_rows_with_an_unmapped_resource(spark, pair):
    roles = spark.createDataFrame([("R1", "desk")], "resource string, role string")
    got = {r["metric"]: r["value"] for r in X.metric_rows(*pair, 0, 0, 0, "B", (us(9), us(15)), roles).collect()}
    assert got["activity_role.jaccard"] == pytest.approx(1 / 6)


def test_unknown_role_is_an_error(spark, pair):
    with pytest.raises(Exception, match="no role"):
        M.state_distances(*pair, ["activity_role"], roles=spark.createDataFrame([("R1", "x")], "resource string, role string")).collect()


def test_validation(spark):
    with pytest.raises(L.InvalidLog):
        L.validate(log(spark, ("c", "A", 11, 10, "R")))
    with pytest.raises(L.InvalidLog):
        L.validate(log(spark, ("c", "A", 11, None, "R")))


def test_running_over_ranges(spark):
    """Sums, next places and positions over ranges of 20 rows equal those of one window; orders are numbers, strings and structs, nulls too."""
    keys = [("k" if i % 3 else None, i, i % 5) for i in range(1000)] + [(f"few{i % 40}", i, 1) for i in range(200)]
    df = spark.createDataFrame(keys, "k string, t long, d int").repartition(7)
    df = df.withColumns({"s": F.md5(F.col("t").cast("string")), "o": F.struct((F.col("t") % 10).alias("x"), "t")})
    for order in ("t", "s", "o"):
        want = running(df, ["k"], order, ["d"]).collect()
        got = running(df, ["k"], order, ["d"], rows_a_range=20).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 1200
        assert got[0].asDict().keys() == want[0].asDict().keys()
    one = df.filter("k = 'k'")
    for order in (["t"], ["s"], ["o"], ["d", "t"]):
        want = sorted(one.collect(), key=lambda r: tuple(r[c] for c in order))
        got = {r["t"]: r["n"] for r in numbered(one, *order, rows_a_range=20).collect()}
        assert got == {r["t"]: i for i, r in enumerate(want)}
    assert sorted(map(repr, running(one, [], "s", ["d"], 20).collect())) == sorted(map(repr, running(one, [], "s", ["d"]).collect()))


def test_sweep_over_ranges(spark):
    """A stored sweep whose keys and views are cut into ranges of 30 rows gives what one window gives, in all that reads it."""
    r = random.Random(14)
    side = lambda n: W.normalise_events(log(spark, *[(f"c{r.randint(0, 9)}", r.choice("AB"), (a := r.randint(0, 400)), a + r.randint(1, 60), f"R{i % 3}") for i in range(n)]))[0]
    found = B.intervals(side(150), side(130), ["activity", "case", "activity_resource"])
    got = []
    for n in (30, 500_000):
        sweep = B.Sweep(found, n)
        parts = (sweep.keyed, sweep.steps, B.timeline(sweep), B.contributors(sweep), B.interval_contributors(sweep, 2))
        got.append([sorted([tuple(f"{v:.7g}" if isinstance(v, float) else v for v in row) for row in x.select(*sorted(x.columns)).collect()], key=repr) for x in parts])
    assert got[0] == got[1]


def test_transforms_over_ranges(spark, monkeypatch):
    """Draws and arrivals counted over ranges of 20 rows give the rows that one window gives."""
    rows = [(f"c{i % 150}", "AB"[i % 2], i // 3, i // 3 + 2, f"R{i % 7}") for i in range(600)]
    x = log(spark, *rows).withColumn("case_type", F.when(F.pmod(F.xxhash64("case_id"), F.lit(3)) == 0, "p").otherwise("q")).repartition(5)
    other = x.withColumn("activity", F.lower("activity"))
    made = {
        "relabel": lambda: T.relabel_fraction(x, "A", "Z", 0.4),
        "mix": lambda: T.merge_at_ratio(x, other, 0.3, 100),
        "swap": lambda: T.swap_case_types(x, 0.5),
        "drift": lambda: T.drift_case_types(x, 0.6),
        "roles": lambda: T.swap_roles(x, spark.createDataFrame([(f"R{i}", "ab"[i == 6]) for i in range(7)], "resource string, role string"), "a", "b", 0),
    }
    want = {k: sorted(map(repr, f().collect())) for k, f in made.items()}
    changed = [k for k in made if want[k] != sorted(map(repr, x.collect()))]
    assert {"relabel", "mix", "swap", "drift"} <= set(changed)
    monkeypatch.setattr(T, "numbered", lambda df, *order: numbered(df, *order, rows_a_range=20))
    assert {k: sorted(map(repr, f().collect())) for k, f in made.items()} == want


def test_cuts(spark):
    x = log(spark, ("c1", "A", 0, 2, "R"), ("c2", "A", 1, 3, "R"), ("c3", "A", 1.5, 3.5, "R"))
    assert us(1.5) <= C.n_ongoing(x, 3).first()["t"]
    assert C.fraction_of_log(log(spark, ("c1", "A", 0, 2, "R"), ("c2", "A", 4, 6, "R")), 0.5) == us(3)
    wide = log(spark, *[(f"c{i}", "A", 12 * i, 12 * i + 6, "R") for i in range(100)])
    times = [r["t"] for r in C.segment10(wide, 24 * HOUR).orderBy("segment").collect()]
    assert len(times) == 10 and times == sorted(times)
    with pytest.raises(L.InvalidLog):
        C.segment10(x, 24 * HOUR)


def test_remaining_time_padding(spark):
    a = log(spark, *[(f"c{i}", "A", 9, 12, "R") for i in range(3)])
    b = log(spark, ("c0", "A", 9, 12, "R"))
    assert D.remaining_time(a, b, us(10)).first()["distance"] == pytest.approx(4 / 3)
    assert D.remaining_time(a, a, us(10)).first()["distance"] == 0
    assert D.remaining_time(a, a.limit(0), us(10)).first()["distance"] is None


def test_utilisation(spark):
    x = log(spark, ("a", "A", 1, 2, "R1"), ("b", "A", 1, 2.5, "R2"), ("c", "A", 9, 10, "R1"))
    roles = spark.createDataFrame([("R1", "team"), ("R2", "team"), ("R3", "idle")], "resource string, role string")
    got = A.utilisation(x, roles, us(0), us(4))
    assert one(got, role="team")["utilization"] == pytest.approx(9000 / 28800)
    assert one(got, role="idle")["utilization"] == 0


def test_concordance(spark):
    rows = spark.createDataFrame([("s", "f", "m", 0, 0.0), ("s", "f", "m", 1, 1.0), ("s", "f", "m", 2, 0.5)], "scope string, family string, metric string, level int, value double")
    assert R.concordance(rows, R.GROUP).first()["c_index"] == pytest.approx(2 / 3)
    got = R.rankings(rows, 20).first()
    assert got["n_levels"] == 3 and got["c_index_ci_low"] <= got["c_index_ci_high"]


def test_relabel_and_transforms(spark):
    x = log(spark, *[("c", "X", i, i + 1, "R") for i in range(10)], *[("d", "Y", i, i + 1, "R") for i in range(5)])
    got = T.relabel_fraction(x, "X", "new", 0.3)
    assert got.filter("activity = 'new'").count() == 3 and got.filter("activity = 'Y'").count() == 5
    total = lambda d: d.groupBy("case_id").agg(F.sum(micros("end_time") - micros("start_time")).alias("d")).orderBy("case_id").collect()
    assert total(T.front_back_load(x, 0.5)) == total(x)
    with pytest.raises(ValueError):
        T.automate(x, ["X"], 101)
    with pytest.raises(L.InvalidLog):
        T.automate(x, ["nothing"], 50)


def test_subsets(spark):
    x = log(spark, ("c1", "A", 8, 11, "R"), ("c2", "A", 9, 9.5, "R"), ("c2", "B", 11, 12, "R"), ("c3", "A", 11, 12, "R"), ("c4", "A", 14, 15, "R"))
    o, c = W.snapshot_subsets(x, spark.createDataFrame([("c1",)], "case_id string"), us(10), us(14))
    assert {r["case_id"] for r in o.collect()} == {"c1", "c2"} and {r["case_id"] for r in c.collect()} == {"c3"}


def test_subsets_dealt_over_tasks(spark):
    """Random cases, some without id or times, dealt over few and many tasks, give what is counted case by case; the tasks grow with the log."""
    r = random.Random(19)
    rows = []
    for _ in range(600):
        s = r.choice([None, *range(20)])
        rows.append((r.choice([None, "hot", "hot", *[f"c{k}" for k in range(80)]]), r.choice("AB"), s, None if s is None else r.choice([None, s, s + 1, s + 5]), "R"))
    x = spark.createDataFrame([(i, c, a, "R", None if s is None else at(s), None if t is None else at(t)) for i, (c, a, s, t, _) in enumerate(rows)], SCHEMA).repartition(5)
    given = ["c1", "c1", "c2", "absent", None]
    cut, end = 10, 14
    spans = {c: [f(v) if (v := [row[k] for row in rows if row[0] == c and row[k] is not None]) else None for f, k in ((min, 2), (max, 3))] for c in {row[0] for row in rows} - {None}}
    ongoing = {c for c, (a, b) in spans.items() if c in given or (a is not None and b is not None and a < cut < b)}
    complete = {c for c, (a, _) in spans.items() if c not in ongoing and a is not None and cut <= a < end}
    want = [sorted((i, c, None if s is None else at(max(s, cut) if k == 0 else s), None if t is None else at(t)) for i, (c, _, s, t, _) in enumerate(rows) if c in found) for k, found in enumerate((ongoing, complete))]
    assert want[0] and want[1]
    utc = lambda t: t and t.astimezone(timezone.utc)
    for size in (500_000, 20):
        parts = W.snapshot_subsets(x, spark.createDataFrame([(c,) for c in given], "case_id string"), us(cut), us(end), size)
        assert [sorted((q["id"], q["case_id"], utc(q["start_time"]), utc(q["end_time"])) for q in p.collect()) for p in parts] == want
    labelled = W.snapshot_labelled(x, spark.createDataFrame([("c1",)], "case_id string"), us(cut), us(end), 20)
    assert labelled.rdd.getNumPartitions() == 30
    empty = W.snapshot_labelled(x.limit(0), spark.createDataFrame([("c1",)], "case_id string"), us(cut), us(end))
    assert empty.count() == 0


def test_case_bounds_dealt_over_tasks(spark):
    """Bounds joined back over many tasks are those over one, and the tasks grow with the log."""
    x = log(spark, *[("hot" if i % 3 else f"c{i % 7}", "A", i % 11, i % 11 + 1 + i % 4, "R") for i in range(100)])
    few, many = W.with_case_bounds(x), W.with_case_bounds(x, 20)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() == 100
    assert many.rdd.getNumPartitions() == 5
    plan = many._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan


def test_snapshot_query_joins_once_without_sorts(spark):
    """A task neither sorts its rows nor holds both subsets' joins at once."""
    plan = catalog.queries()["f4_snapshot_subsets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan


def test_assessment(pair):
    a, b = (W.normalise_events(x)[0] for x in pair)
    found = B.Sweep(B.intervals(a, b, ["activity"]))
    assert B.scores(B.timeline(found)).first()["overall_score"] == pytest.approx(1 / 3)
    parts = {r["key"][0]: r["share"] for r in B.contributors(found).collect()}
    assert parts == {"B": pytest.approx(0.5), "C": pytest.approx(0.5)}
    assert B.select_views(["Activity-Case", "nothing", "activity_role"], a, b, False) == ["activity_case"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00+00:00", "a b!"), (None, "--")], "t string, n string")
    got = df.select(ensure_fractional_seconds(F.col("t")).alias("t"), safe_name(F.col("n")).alias("n")).collect()
    assert [r["t"] for r in got] == ["2024-01-01T10:00:00.000+00:00", None] and [r["n"] for r in got] == ["a_b", "act"]


def test_rounding_as_sql_has_it(spark):
    """Halves of the sixth digit, and of a second, as DuckDB rounds them."""
    import duckdb

    from tracework.plans.base import rounded

    values = [41 / 640, 1 / 128, 3 / 128, 0.0003125, 77 / 3200, -1 / 128, 0.5, 2.5, 1e6 / 3]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    got = [r["x"] for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").coalesce(1).sortWithinPartitions("i")).collect()]
    assert got == want and want[0] == 0.064062


def test_sweep_by_ranges_of_time(spark):
    """Ranges send an instance once a range, and where all instances overlap, boundaries are dealt by their keys; the results are the same."""
    r = random.Random(5)
    make = lambda n, far: log(spark, *[(f"c{r.randint(0, 9)}", r.choice("AB"), (a := r.randint(0, 400)), a + r.randint(1, far), f"R{i % 3}") for i in range(n)])
    for far in (5, 2000):
        rows, keys = B.spans(*[W.normalise_events(make(n, far))[0] for n in (200, 180)], ["activity", "case", "activity_resource"])
        one, many = (B.Sweep(rows, n, keys) for n in (1_000_000, 40))
        assert one.cut == [] and (many.cut is None if far == 2000 else len(many.cut) > 5)
        if many.cut:
            plan = many.swept._sc._jvm.PythonSQLUtils.explainString(many.swept._jdf.queryExecution(), "simple")
            assert plan.count("Exchange") == 1, plan
        for read in (lambda s: s.steps, B.swept_scores, B.contributors, lambda s: B.interval_contributors(s, 2, 20), lambda s: M.summary(M.timeline(s, whole=False))):
            a, b = (sorted(repr([f"{v:.7g}" if isinstance(v, float) else v for v in row]) for row in read(s).collect()) for s in (one, many))
            assert a == b and a


def test_cuts_are_found_once(spark):
    """Features read a table of cuts, and a span meets only the cuts of the ranges it touches."""
    from tracework.operators import features as L

    x = log(spark, *[(f"c{i}", "A", i, i + 3, "R") for i in range(200)])
    cuts = W.subsample(x.select(F.unix_micros("end_time").alias("t")).distinct(), 80)
    assert cuts.count() == 80 and cuts.inputFiles()
    assert "Window" not in cuts._sc._jvm.PythonSQLUtils.explainString(cuts._jdf.queryExecution(), "simple")
    found = L.stabbed(L._active(x), cuts)
    assert found.count() == sum(1 for i in range(200) for (t,) in cuts.collect() if us(i) <= t < us(i + 3))
