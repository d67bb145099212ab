"""Quantiles, inversions and busy hours against plain versions, over one range and over many."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracework.operators import distances as D
from tracework.operators import ranking as R
from tracework.operators import snapshot as P
from tracework.operators import transforms as T
from tracework.operators import windows as W
from tracework.operators.quantiles import quantiles
from tracework.operators.running import earlier


@pytest.mark.parametrize("rows_a_range", [15, 500_000])
def test_quantiles(spark, rows_a_range):
    r = random.Random(4)
    rows = [("ab"[i % 2], r.choice([None, 1.5, r.random(), float(r.randint(0, 9))])) for i in range(400)] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    qs = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {x["k"]: x["quantiles"] for x in quantiles(df, F.col("v"), qs, ["k"], rows_a_range).collect()}
    for k in "abc":
        assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k and v is not None], qs))
    assert "d" not in got
    assert quantiles(df, F.col("v"), qs, rows_a_range=rows_a_range).first()["quantiles"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], qs))
    assert quantiles(df.limit(0), F.col("v"), qs).collect()[0]["quantiles"] is None


@pytest.mark.parametrize("rows_a_range", [15, 500_000])
def test_concordance_counts_inversions(spark, rows_a_range):
    r = random.Random(6)
    rows = [(m, r.choice([0, 5, 10, 11, 40]), float(r.randint(0, 30))) for m in "xy" for _ in range(150)] + [("one level", 3, 1.0), ("x", None, 1.0), ("x", 5, None)]
    df = spark.createDataFrame(rows, "m string, level int, value double").repartition(3)
    got = {x["m"]: x["c_index"] for x in R.concordance(df, ["m"], rows_a_range).collect()}
    want = {}
    for m in "xy":
        own = [(a, v) for x, a, v in rows if x == m and a is not None and v is not None]
        pairs = [(v, w) for a, v in own for b, w in own if a < b]
        want[m] = sum((w > v) + 0.5 * (w == v) for v, w in pairs) / len(pairs)
    assert got == pytest.approx(want)


def test_concordance_of_many_values(spark):
    """Two levels of 50,000 different values: 2.5e9 pairs, none of which is built."""
    df = spark.range(100_000).select(F.lit("m").alias("m"), (F.col("id") % 2).cast("int").alias("level"), F.col("id").cast("double").alias("value"))
    assert R.concordance(df, ["m"], 20_000).first()["c_index"] == pytest.approx((50_000 * 50_001 / 2) / 50_000**2)


def test_busy_hours(spark):
    r = random.Random(2)
    base = datetime(2024, 1, 3, 5, 20, tzinfo=timezone.utc)
    rows = []
    for i in range(120):
        a = base + timedelta(minutes=r.randint(0, 60 * 24 * 20))
        rows.append((r.choice(["r1", "r2", "r3", None]), a, a + timedelta(minutes=r.choice([0, 5, 59, 600, 12_000, 30_000, -5]))))
    rows.append(("r9", base, base + timedelta(days=3653)))
    busy = {(n, h) for n, a, b in rows if n and b >= a for h in range(int(a.timestamp()) // 3600, int(b.timestamp()) // 3600 + 1)}
    want = Counter((datetime.fromtimestamp(h * 3600, timezone.utc).weekday(), h % 24) for _, h in busy)
    df = spark.createDataFrame(rows, "resource string, start_time timestamp, end_time timestamp")
    got = D.busy_hours(df)
    assert {(x["day"], x["bin"]): x["n"] for x in got.collect()} == dict(want)
    assert D.busy_hours(df.limit(0)).count() == 0


def test_sequences_of_split_cases(spark):
    """One case of 500 rows and others of few, cut into ranges of 20 rows, give what one window gives."""
    r = random.Random(9)
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(700):
        a = base + timedelta(minutes=r.randint(0, 3000))
        rows.append((i, "long" if i < 500 else f"c{i % 50}" if i % 9 else None, r.choice("ABC"), "R", a, a + timedelta(minutes=r.randint(0, 90))))
    log = spark.createDataFrame(rows, "id long, case_id string, activity string, resource string, start_time timestamp, end_time timestamp").repartition(6)
    seconds = log.select("id", "case_id", F.unix_seconds("start_time").cast("double").alias("start"), F.unix_seconds("end_time").cast("double").alias("end"), F.when(F.col("id") % 7 == 0, 1.0).alias("enable"))
    made = {
        "fill": lambda n: W.fill_enable(seconds, n), "grams": lambda n: D.n_grams(log, 4, n), "order": lambda n: P.ordered(log, n), "load": lambda n: T.front_back_load(log, 0.4, n),
        "look": lambda n: earlier(log, ["case_id"], ["start_time", "id"], {"p": ("activity", 1), "q": ("id", 30)}, n), "all": lambda n: earlier(log, [], ["id"], {"p": ("id", 25)}, n),
    }
    for name, f in made.items():
        want, got = f(500_000), f(20)
        assert sorted(want.columns) == sorted(got.columns), name
        assert sorted(map(repr, want.select(*sorted(want.columns)).collect())) == sorted(map(repr, got.select(*sorted(want.columns)).collect())), name


def test_markings_of_unique_suffixes(spark):
    """The longest suffix that the index knows with one marking, for random traces and grams, some of them with two."""
    r = random.Random(12)
    grams = {tuple(r.choice("ab") for _ in range(r.randint(1, 6))): [r.choice(["m1", "m2", "m3"]) for _ in range(r.choice([1, 1, 2, 3]))] for _ in range(60)}
    index = [(list(g), [m]) for g, ms in grams.items() for m in ms] + [([], ["never"])]
    traces = [(f"c{i}", [r.choice("ab") for _ in range(r.randint(0, 30))]) for i in range(200)]
    got = P.markings(spark.createDataFrame(traces, "case_id string, trace array<string>"), spark.createDataFrame(index, "gram array<string>, marking array<string>"), 4)
    want = {}
    for c, t in traces:
        known = [grams[tuple(t[-k:])][0] for k in range(1, min(4, len(t)) + 1) if len(set(grams.get(tuple(t[-k:]), "xy"))) == 1]
        want[c] = known[-1:]
    assert {x["case_id"]: x["marking"] for x in got.collect()} == want and sum(map(len, want.values())) > 50
