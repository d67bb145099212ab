"""Areas measured by ranges of time against the sweep by windows, and what a task of them does."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from tests.test_core import log
from tracework.operators import assess as B
from tracework.operators import windows as W
from tracework.operators.running import range_of
from tracework.plans import catalog

VIEWS = ["activity", "case", "activity_case", "activity_resource", "activity_phase"]


def events(spark, seed, n, far=40, starts=400):
    r = random.Random(seed)
    rows = [(r.choice([None, *[f"c{k}" for k in range(9)]]), r.choice("AB"), (a := r.randint(0, starts)), a + r.randint(1, far), r.choice([None, "R1", "R2"])) for _ in range(n)]
    return W.fill_enable(W.normalise_events(log(spark, *rows))[0])


def plain(df):
    return sorted(repr([f"{v:.7g}" if isinstance(v, float) else v for v in row]) for row in df.select(*sorted(df.columns)).collect())


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("far", [5, 40, 2000])
def test_areas_are_those_of_the_sweep(spark, far):
    """Scores and contributors over few ranges, many, or none (most instances overlap) are those of windows over all boundaries."""
    a, b = (events(spark, k, n, far) for k, n in ((3, 200), (4, 180)))
    rows, keys = B.spans(a, b, VIEWS)
    one, many = B.swept(a, b, VIEWS), B.swept(a, b, VIEWS)
    many.wanted = 40
    old = B.Sweep(rows, keys=keys)
    assert one.wide == [] and (many.wide is None if far == 2000 else len(many.wide) >= 2)
    for read in (B.swept_scores, B.contributors):
        want = plain(read(old))
        assert want and plain(read(one)) == want and plain(read(many)) == want


def test_scores_sort_nothing_in_windows(spark):
    """a range's instances stream to a task that measures all views, where windows held every boundary of every view, twice."""
    plan = explained(catalog.queries()["b1_b6_scores"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "MapInArrow" in plan, plan


def test_an_assessment_makes_what_is_asked(spark):
    """F1: scores and contributors read one table that the sweep has written; interval contributors and names of keys are not made for them."""
    logs = [log(spark, *[(f"c{i % 5}", "AB"[i % 2], i, i + 2 + k, "R") for i in range(30)]) for k in range(2)]
    found = B.assess(*logs)
    assert set(found) >= {"meta", "scores", "timeline", "contributors", "intervals", "text"}
    parts, score = found["parts"], found["scores"]
    assert parts.inputFiles() and set(score.inputFiles()) <= set(parts.inputFiles())
    assert all(w not in explained(x) for x in (parts, score) for w in ("MapInArrow", "lag(", "xxhash64"))
    assert set(found._found) == {"parts", "scores"}


def test_many_instances_at_once_are_no_range(spark):
    """Where more instances begin at one moment than a task may hold, boundaries are dealt by their keys; results are the same."""
    a, b = (events(spark, k, 150, starts=0) for k in (5, 6))
    one, many = B.swept(a, b, VIEWS), B.swept(a, b, VIEWS)
    many.wanted = 20
    assert many.wide is None
    assert plain(B.swept_scores(many)) == plain(B.swept_scores(one)) and plain(B.contributors(many)) == plain(B.contributors(one))


def test_equal_areas_stay_equal(spark):
    """Views that differ alike have the same score to the last bit over many ranges, so that their names decide the rank."""
    a, b = (events(spark, k, 150, 5).withColumns({"activity": F.lit("A"), "resource": F.col("case_id")}) for k in (7, 8))
    found = B.swept(a, b, ["activity_case", "activity_case_resource", "activity_resource"])
    found.wanted = 20
    assert len(found.wide) > 3 and len({r["overall_score"] for r in B.swept_scores(found).collect()}) == 1


def test_range_of_is_a_bisection(spark):
    """Bounds spread evenly, unevenly, or all in one cell; values on them, between them and beyond."""
    r = random.Random(2)
    for draw in (lambda: r.randint(0, 10**15), lambda: 1.7e9 + r.random(), lambda: r.random() ** 40, lambda: -r.randint(0, 30), lambda: 7):
        values = [draw() for _ in range(500)]
        found = sorted(set(values[:60]))
        values += [*found, found[0] - 1, found[-1] + 1, 10 * abs(found[-1]) + 1]
        df = spark.createDataFrame([(v,) for v in values], "x double" if isinstance(found[0], float) else "x long")
        assert all(r["n"] == bisect_right(found, r["x"]) for r in df.select("x", range_of(F.col("x"), found).alias("n")).collect())
