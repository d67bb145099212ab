"""Ladders: nested draws, and the same numbers at every level whatever the replicate."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tracework.operators import ladders as LA


def scoped(spark, n=200):
    at = lambda h: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=h)
    rows = [(i, f"c{i % 40}", "AB"[i % 2], f"R{i % 5}", at(i % 40), at(i % 40 + 3), "pq"[i % 40 % 2]) for i in range(n)]
    log = spark.createDataFrame(rows, "id long, case_id string, activity string, resource string, start_time timestamp, end_time timestamp, case_type string")
    return log, log.withColumn("scope", F.lit("B"))


def test_relabelling_is_nested(spark):
    _, base = scoped(spark)
    steps = LA.steps([0, 30, 60, 100], 3)
    _, new = LA.relabel(base, "A", "Z", steps)
    assert new.count() == 200 * len(steps)
    hit = {}
    for r in new.filter("activity = 'Z'").collect():
        hit.setdefault((r["level"], r["k"]), set()).add(r["id"])
    for k in range(3):
        assert [len(hit.get((v, k), ())) for v in (0, 30, 60, 100)] == [0, 30, 60, 100] and hit[30, k] < hit[60, k] < hit[100, k]
    assert hit[30, 0] != hit[30, 1]


def test_types_keep_their_numbers(spark):
    log, base = scoped(spark)
    steps = LA.steps([0, 50, 100], 2)
    for flow in (LA.swap, LA.drift):
        _, new = flow(log, base, steps)
        first = new.groupBy("level", "k", "case_id").agg(F.min("case_type").alias("t"), F.max("case_type").alias("u"), F.min("start_time").alias("s")).collect()
        assert all(r["t"] == r["u"] for r in first)
        for step in steps:
            own = [r for r in first if (r["level"], r["k"]) == step]
            assert len(own) == 40 and sum(r["t"] == "p" for r in own) == 20
            if flow is LA.drift and step[0] == 100:  # the smaller type has come first altogether
                assert [r["t"] for r in sorted(own, key=lambda r: (r["s"], r["case_id"]))] == ["p"] * 20 + ["q"] * 20
            if step[0] == 0:
                assert {r["case_id"]: r["t"] for r in own} == {f"c{i}": "pq"[i % 2] for i in range(40)}


def test_rows_of_equal_logs_are_zero(spark):
    log, base = scoped(spark)
    steps = LA.steps([0, 40], 2)
    a = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000
    got = LA.rows(*LA.relabel(base, "A", "Z", steps), steps, (a, a + 43 * 3_600_000_000)).collect()
    assert len(got) == 4 * (5 + 1 + 4)
    assert all(r["value"] == 0 for r in got if r["level"] == 0)
    changed = {(r["metric"], r["value"] > 0) for r in got if r["level"] == 40}
    assert {("activity.jaccard", True), ("case.jaccard", False), ("ngd_n2", True), ("cycle_time", False), ("rtd", False)} <= changed
    green, red = log, log.withColumn("activity", F.lower("activity"))
    _, new = LA.mix(green, red, 0.5, 30, a + 20 * 3_600_000_000, 10 * 3_600_000_000, LA.steps([0, 20, 90], 2))
    assert {r["level"] for r in new.select("level").distinct().collect()} == {0.0, 20.0}


def test_steps_are_dealt_over_tasks(spark):
    """A ladder's steps share ranges of time but not tasks; ranges and groups change no result."""
    from tracework.operators import sweep as M

    _, base = scoped(spark)
    steps = LA.steps([0, 40], 3)
    base, new = LA.relabel(base, "A", "Z", steps)
    a, b = (x.withColumn("group", F.concat_ws(":", "level", "k", "scope")) for x in (LA.each_step(base, steps), new))
    rows, keys = M.spans(a, b, ["activity", "case"], group="group")
    one, many = M.Sweep(rows, 10**9, keys), M.Sweep(rows, 60, keys, "group")
    assert many.deals == 6 and len(many.cut) > 2 and many.changes.rdd.getNumPartitions() == 6 * (len(many.cut) + 1)
    for read in (lambda s: M.timeline(s), lambda s: M.summary(M.timeline(s, whole=False))):
        x, y = (sorted(repr([f"{v:.7g}" if isinstance(v, float) else v for v in row]) for row in read(s).collect()) for s in (one, many))
        assert x == y and x
