"""Queries: logs, windows, cuts, aggregates, distances and state metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracework import log as L
from tracework.functions.scalar import HOUR, micros, moment
from tracework.operators import aggregates as A
from tracework.operators import cuts as C
from tracework.operators import distances as D
from tracework.operators import sweep as M
from tracework.operators import windows as W
from tracework.plans.base import BASE, DAY, HORIZON, Logs, micros_out, rounded

Q: dict = {}
SQL: dict = {}
KEEP = ["id", "case_id", "activity", "start_time", "end_time"]
OUT = "id, case_id, activity, s AS start_time, t AS end_time"


def query(name: str, sql: str | None = None):
    """Register fn(logs) under a name, with the rest of a DuckDB query after BASE."""

    def add(fn):
        Q[name] = lambda spark, d: rounded(fn(Logs(spark, d)))
        if sql:
            SQL[name] = BASE + sql
        return fn

    return add


def rows(df):
    return micros_out(df.select(*KEEP))


def tagged(**parts):
    out = None
    for k, df in parts.items():
        df = rows(df).withColumn("subset", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out


# Windows and filters

query("f1_trim_events", f"SELECT id, case_id, activity, greatest(s, cut) AS start_time, least(t, fin) AS end_time FROM e, p WHERE t >= cut AND s <= fin")(lambda x: rows(W.trim_events(x.e, x.cut, x.end)))

_SPLIT = """, b AS (SELECT case_id, min(s) AS f, max(t) AS l FROM e GROUP BY 1)
SELECT 'ongoing' AS subset, {o} FROM e JOIN b USING (case_id), p WHERE f < cut AND l > cut AND t > cut
UNION ALL SELECT 'complete', {o} FROM e JOIN b USING (case_id), p WHERE f >= cut AND f <= fin"""


@query("f2_split_cases", _SPLIT.format(o=OUT))
def _(x):
    o, c = W.split_cases(x.e, x.cut, x.end)
    return tagged(ongoing=o, complete=c)


@query("f3_split_into_subsets", _SPLIT.format(o=OUT) + " UNION ALL SELECT 'events', id, case_id, activity, greatest(s, cut), least(t, fin) FROM e, p WHERE t >= cut AND s <= fin")
def _(x):
    v, o, c = W.split_into_subsets(x.e, x.cut, x.end)
    return tagged(events=v, ongoing=o, complete=c)


def _partial(x):
    return x.e.filter("user_id % 10 = 0 AND resource = 'R3'").select("case_id").distinct()


@query(
    "f4_snapshot_subsets",
    """, b AS (SELECT case_id, min(s) AS f, max(t) AS l FROM e GROUP BY 1),
i AS (SELECT case_id FROM e WHERE user_id % 10 = 0 AND resource = 'R3' UNION SELECT case_id FROM b, p WHERE f < cut AND l > cut)
SELECT 'ongoing' AS subset, id, case_id, activity, greatest(s, cut) AS start_time, t AS end_time FROM e, p WHERE case_id IN (SELECT case_id FROM i)
UNION ALL SELECT 'complete', id, case_id, activity, s, t FROM e WHERE case_id IN (SELECT case_id FROM b, p WHERE f >= cut AND f < fin AND case_id NOT IN (SELECT case_id FROM i))""",
)
def _(x):
    found = W.snapshot_labelled(x.e.select(*KEEP), _partial(x), x.cut, x.end)
    return micros_out(found.select(*KEEP, "subset"))


_IN_WINDOW = "SELECT id, case_id, activity, greatest(s, cut) AS start_time, least(t, fin) AS end_time FROM e, p WHERE t > cut AND s < fin"
query("f5_cases_in_window", (
    f", b AS (SELECT case_id, min(s) AS f, max(t) AS l FROM e GROUP BY 1) {_IN_WINDOW} AND case_id IN (SELECT case_id"
    f" FROM b, p WHERE f < cut AND l > cut)"
))(lambda x: rows(W.cases_in_window(x.e, W.ongoing_case_ids(x.e, x.cut), x.cut, HORIZON)))
query("f6_ongoing_case_ids", "SELECT case_id FROM e GROUP BY 1 HAVING min(s) < (SELECT cut FROM p) AND max(t) > (SELECT cut FROM p)")(lambda x: W.ongoing_case_ids(x.e, x.cut))
query(
    "f7_prepare_snapshot",
    "SELECT id, case_id, activity, s AS start_time, CASE WHEN t <= cut THEN t END AS end_time FROM e, p WHERE s <= cut AND case_id IN (SELECT case_id FROM e, p WHERE s > cut OR t > cut)",
)(lambda x: rows(W.prepare_snapshot(x.e, x.cut)))


@query(
    "f8_split_train_test",
    """, z AS (SELECT min(s) AS a, CAST(trunc((max(t) - min(s)) * 0.8) AS BIGINT) AS u FROM e), c AS (SELECT a, a + u AS used, a + CAST(trunc(u * 0.4) AS BIGINT) AS k FROM z),
b AS (SELECT case_id, min(s) AS f FROM e GROUP BY 1)
SELECT CASE WHEN f <= k THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT e.case_id) AS cases FROM e JOIN b USING (case_id), c WHERE f <= used GROUP BY 1""",
)
def _(x):
    train, test, _cut = W.split_train_test(x.e, 0.4, 0.8)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"))


@query("f9_validate_log", "SELECT count(*) AS n FROM e WHERE t >= s")
def _(x):
    return L.validate(x.e).agg(F.count(F.lit(1)).alias("n"))


query("f10_positive_intervals", f"SELECT {OUT} FROM e WHERE t > s")(lambda x: rows(x.e.filter("end_time > start_time")))


def _raw(x):
    """A log as text, with some broken rows."""
    bad = F.when(F.col("id") % 50 == 0, F.lit("nothing")).when(F.col("id") % 50 == 1, F.col("start_time").cast("string")).otherwise(F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return x.e.select("id", "case_id", "activity", "resource", F.when(F.col("id") % 3 == 0, (micros("start_time") / 1e6).cast("decimal(20,6)").cast("string")).otherwise(F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("start_time"), bad.alias("end_time"))


_NORM = (
    ", n AS (SELECT id, case_id, activity, resource, s / 1e6 AS st, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN s / 1e6 ELSE t / 1e6 END AS en"
    " FROM e), v AS (SELECT * FROM n WHERE en > st)"
)


@query("f11_normalise_events", _NORM + " SELECT v.id, v.case_id, v.activity, r.role, round(st, 6) AS start, round(en, 6) AS \"end\" FROM v LEFT JOIN r USING (resource)")
def _(x):
    ev, _n = W.normalise_events(_raw(x), roles=x.roles)
    return ev.select("id", "case_id", "activity", "role", "start", "end")


@query("f12_invalid_events", _NORM + " SELECT (SELECT count(*) FROM n) - (SELECT count(*) FROM v) AS invalid, (SELECT count(*) FROM n) AS total")
def _(x):
    return W.normalise_events(_raw(x))[1]


@query("f13_fill_enable", _NORM + " SELECT id, round(lag(en) OVER (PARTITION BY case_id ORDER BY st, en, id), 6) AS enable FROM v")
def _(x):
    return W.fill_enable(W.normalise_events(_raw(x))[0]).select("id", "enable")


@query("f14_normalise_times", (
    ", z AS (SELECT min(s) / 1e6 AS a, max(t) / 1e6 AS b FROM (SELECT s, t FROM e WHERE t > s UNION ALL SELECT s, t FROM g"
    " WHERE t > s)) SELECT id, round((s / 1e6 - a) / (b - a), 6) AS start, round((t / 1e6 - a) / (b - a), 6) AS \"end\""
    " FROM e, z WHERE t > s"
))
def _(x):
    a, _b = W.normalise_times(W.normalise_events(x.e)[0], W.normalise_events(x.g)[0])
    return a.select("id", "start", "end")


_CANDIDATES = ", z AS (SELECT min(s) + 43200000000 AS a, max(t) - 86400000000 AS b FROM e), q AS (SELECT DISTINCT t FROM e, z WHERE t >= a AND t <= b)"
query("f15_candidate_cuts", _CANDIDATES + " SELECT t FROM q")(lambda x: W.candidate_cuts(x.e, DAY))
query("f15_candidate_case_ends", _CANDIDATES + ", w AS (SELECT case_id, max(t) AS t FROM e GROUP BY 1) SELECT DISTINCT w.t FROM w, z WHERE w.t >= a AND w.t <= b")(lambda x: W.candidate_cuts(x.e, DAY, "case_end"))
query(
    "f16_subsample_cuts",
    _CANDIDATES + (
        ", k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n, count(*) OVER () AS c FROM q) SELECT t FROM k"
        " WHERE n IN (SELECT CAST(floor((c - 1) * i / 149) AS BIGINT) FROM (SELECT unnest(range(0, 150)) AS i))"
    ),
)(lambda x: W.subsample(W.candidate_cuts(x.e, DAY), 150))

# Cuts

_WIP = """, b AS (SELECT case_id, min(s) AS f, max(t) AS l FROM {log} GROUP BY 1), d AS (SELECT f AS t, 1 AS d, 1 AS a FROM b UNION ALL SELECT l, -1, 0 FROM b),
w AS (SELECT t, sum(sum(d)) OVER (ORDER BY t) AS wip, sum(a) AS a FROM d GROUP BY t)"""
_W = _WIP.format(log="e")
query("c0_wip", _W + " SELECT t, CAST(wip AS BIGINT) AS wip FROM w")(lambda x: C.wip(x.e))
query("c1_fixed_cut", (
    ", b AS (SELECT case_id, min(s) AS f, max(t) AS l FROM e GROUP BY 1)"
    " SELECT 1705320000000000 AS t, count(*) FILTER (f <= 1705320000000000 AND l > 1705320000000000) AS wip"
    " FROM b HAVING min(f) <= 1705320000000000 AND max(l) >= 1705320000000000"
))(lambda x: C.fixed_cut(x.e, 1705320000000000))
query(
    "c2_wip3",
    _W + (
        ", v AS (SELECT * FROM w WHERE a > 0), k AS (SELECT DISTINCT CAST(round_even((SELECT max(wip)"
        " FROM v) * q, 0) AS BIGINT) AS target FROM (SELECT unnest([0.1, 0.5, 0.9]) AS q))"
        " SELECT target, coalesce(min(t) FILTER (wip = target), min(t) FILTER (wip > target), min(t)) AS t FROM v, k"
        " GROUP BY target"
    ),
)(lambda x: C.wip3(x.e))
query(
    "c3_segment10",
    (
        ", z AS (SELECT min(s) + 172800000000 AS a, max(t) - 172800000000 AS b FROM e)"
        " SELECT k::INT AS segment, CAST(floor(a + (k + ('0x' || substr(md5('segment:' || k), 1, 8))::BIGINT / 4294967296.0) * ((b - a) / 10)) AS BIGINT) AS t"
        " FROM z, (SELECT unnest(range(0, 10)) AS k)"
    ),
)(lambda x: C.segment10(x.e, HORIZON))
_MIDDLE = "(SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n, count(*) OVER () AS c FROM {q}) WHERE n = c // 2)"
query("c4_high_wip", _W + ", h AS (SELECT t FROM w WHERE wip >= (SELECT quantile_cont(wip, 0.9) FROM w)) SELECT * FROM " + _MIDDLE.format(q="h"))(lambda x: C.high_wip(x.e))
query("c5_n_ongoing", _W + ", h AS (SELECT t FROM w WHERE abs(wip - 60) <= 12) SELECT coalesce(" + _MIDDLE.format(q="h") + ", (SELECT t FROM w ORDER BY abs(wip - 60), t LIMIT 1)) AS t")(lambda x: C.n_ongoing(x.e, 60))
query("c5_nearest_ongoing", _W + " SELECT t FROM w ORDER BY abs(wip - 100000), t LIMIT 1")(lambda x: C.n_ongoing(x.e, 100000).select("t"))


@query("c6_fraction_cut", "SELECT count(*) AS n FROM e WHERE s <= (SELECT min(s) + CAST(trunc((max(t) - min(s)) * 0.25) AS BIGINT) FROM e)")
def _(x):
    return x.e.filter(micros("start_time") <= C.fraction_of_log(x.e, 0.25)).agg(F.count(F.lit(1)).alias("n"))


_H7 = ", b AS (SELECT case_id, min(s) AS f, max(t) AS l FROM e GROUP BY 1), h AS (SELECT least(CAST(trunc(2 * (SELECT avg(l - f) FROM b)) AS BIGINT), (SELECT max(t) FROM e) - cut) AS h, cut FROM p)"


@query("c7_adaptive_horizon", _H7 + " SELECT count(*) AS n FROM e, h WHERE t > cut AND s < cut + h")
def _(x):
    return W.cases_in_window(x.e, None, x.cut, C.adaptive_horizon(x.e, x.cut)).agg(F.count(F.lit(1)).alias("n"))


@query("c8_fixed_horizon", "SELECT count(*) AS n FROM e, p WHERE t > cut AND s < cut + least(259200000000, (SELECT max(t) FROM e) - cut)")
def _(x):
    return W.cases_in_window(x.e, None, x.cut, C.fixed_horizon(x.e, x.cut, 72)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c9_warmup_shift",
    _WIP.format(log="g") + (
        ", o AS (SELECT count(*) AS n FROM (SELECT case_id FROM e GROUP BY 1 HAVING min(s) < (SELECT cut"
        " FROM p) AND max(t) > (SELECT cut FROM p))), m AS (SELECT coalesce((SELECT min(w.t) FROM w, o, p"
        " WHERE a > 0 AND w.t <= cut AND wip = o.n), (SELECT cut FROM p)) AS m)"
        " SELECT id, s + cut - m AS start_time, t + cut - m AS end_time FROM g, p, m"
    ),
)
def _(x):
    n = W.ongoing_case_ids(x.e, x.cut).count()
    return micros_out(C.warmup_shift(x.g, x.cut, n)[0].select("id", "start_time", "end_time"))


# Aggregates

query("a1_case_bounds", "SELECT case_id, min(s) AS first, max(t) AS last FROM e GROUP BY 1")(lambda x: L.case_bounds(x.e))
_REM = "(SELECT coalesce(avg(l - cut) / 1e6, 0) FROM (SELECT case_id, max(t) AS l FROM {log} GROUP BY 1), p)"
query("a2_avg_remaining_time", "SELECT round(" + _REM.format(log="e") + ", 6) AS avg_remaining")(lambda x: A.avg_remaining_time(x.e, x.cut))
query("a3_remaining_difference", ", z AS (SELECT " + _REM.format(log="e") + " AS x, " + _REM.format(log="g") + " AS y) SELECT round(abs(x - y) / nullif(x, 0), 6) AS value FROM z")(lambda x: A.remaining_difference(x.e, x.g, x.cut))
query("a4_events_per_case", "SELECT count(DISTINCT case_id) AS cases, count(*) AS events, round(count(*) / count(DISTINCT case_id), 6) AS events_per_case FROM e")(lambda x: A.case_counts(x.e))
query("a5_case_differences", (
    "SELECT abs(count(DISTINCT case_id) - (SELECT count(DISTINCT case_id)"
    " FROM g)) AS cases_diff, round(abs(count(*) / count(DISTINCT case_id) - (SELECT count(*) / count(DISTINCT case_id)"
    " FROM g)), 6) AS events_per_case_diff FROM e"
))(lambda x: A.case_differences(x.e, x.g))
query("a6_last_arrival", "SELECT max(f) AS last_case_arrival FROM (SELECT min(s) AS f FROM e GROUP BY case_id)")(lambda x: A.last_arrival(x.e))
query(
    "a7_utilisation",
    (
        ", n AS (SELECT role, count(*) AS n_resources FROM r GROUP BY 1)"
        ", u AS (SELECT role, sum(least(t, fin) - greatest(s, cut)) / 1e6 AS b FROM e JOIN r USING (resource), p"
        " WHERE t > cut AND s < fin GROUP BY 1)"
        " SELECT role, n_resources, round(coalesce(b, 0), 6) AS busy_seconds, 172800.0 AS window_seconds, round(coalesce(b, 0) / (n_resources * 172800), 6) AS utilization"
        " FROM n LEFT JOIN u USING (role)"
    ),
)(lambda x: A.utilisation(x.e, x.roles, x.cut, x.end))
query("a8_target_activity", (
    ", a AS (SELECT activity, count(*) AS n FROM e GROUP BY 1), b AS (SELECT activity, count(*) AS m FROM g GROUP BY 1)"
    " SELECT activity FROM (SELECT b.activity, n, m FROM b LEFT"
    " JOIN a USING (activity)) ORDER BY n IS NULL, n DESC, m DESC, activity LIMIT 1"
))(lambda x: A.target_activity(x.e, x.g))
query("a9_duration_percentile", "SELECT round(greatest(quantile_cont(d, 0.95), 1), 6) AS horizon_seconds FROM (SELECT (max(t) - min(s)) / 1e6 AS d FROM e GROUP BY case_id)")(lambda x: A.duration_percentile(x.e))


def _metrics(x):
    """Metric rows out of the log: runs are resources, metrics are activities."""
    return x.e.groupBy("resource", F.lit("all").alias("subfamily"), F.col("activity").alias("metric")).agg(F.avg((micros("end_time") - micros("start_time")) / 1e6).alias("value"))


_MET = ", m AS (SELECT resource, 'all' AS subfamily, activity AS metric, avg((t - s) / 1e6) AS value FROM e GROUP BY ALL)"
query("a10_a11_aggregate_runs", _MET + " SELECT subfamily, metric, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci FROM m GROUP BY ALL")(lambda x: A.aggregate_runs(_metrics(x), "subfamily", "metric"))
query("a12_aggregate_cuts", _MET + (
    ", k AS (SELECT CAST(substr(resource, 2) AS INT) % 2 AS cut, metric, avg(value) AS mean FROM m GROUP BY ALL)"
    " SELECT metric, round(avg(mean), 6) AS mean FROM k GROUP BY 1"
))(
    lambda x: A.aggregate_cuts(A.aggregate_runs(_metrics(x).withColumn("cut", F.substring("resource", 2, 9).cast("int") % 2), "cut", "metric"), "metric")
)
query("a13_compare", (
    ", a AS (SELECT activity, avg((t - s) / 1e6) AS x FROM e GROUP BY 1), b AS (SELECT activity, avg((t - s) / 1e6) AS y"
    " FROM g GROUP BY 1) SELECT activity, CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN x < y THEN 'A' WHEN x > y THEN 'B' ELSE 'tie' END AS winner"
    " FROM a FULL JOIN b USING (activity)"
))(
    lambda x: A.compare(*[y.groupBy("activity").agg(F.avg((micros("end_time") - micros("start_time")) / 1e6).alias("mean")) for y in (x.e, x.g)], ["activity"])
)
query("a14_spread", _MET + " SELECT metric, round(CASE WHEN count(value) = 1 THEN 0 ELSE 1.96 * stddev_samp(value) END, 6) AS ci FROM m GROUP BY 1")(lambda x: _metrics(x).groupBy("metric").agg(A.spread_ci(F.col("value")).alias("ci")))
query(
    "a19_error_targets",
    _MET + (
        ", k AS (SELECT CASE metric WHEN 'view' THEN 'RTD' WHEN 'click' THEN 'cycle_time' END AS m, avg(value) AS mean, 1.96 * stddev_samp(value) / sqrt(count(value)) AS ci, subfamily"
        " FROM m GROUP BY metric, subfamily)"
        " SELECT subfamily, round(max(CASE WHEN m = 'RTD' THEN mean END), 6) AS \"err_RTD_mean\", round(max(CASE WHEN m = 'RTD' THEN ci END), 6) AS \"err_RTD_ci\", round(max(CASE WHEN m = 'cycle_time' THEN mean END), 6) AS err_cycle_mean, round(max(CASE WHEN m = 'cycle_time' THEN ci END), 6) AS err_cycle_ci"
        " FROM k GROUP BY 1"
    ),
)(lambda x: A.error_targets(A.aggregate_runs(_metrics(x), "subfamily", "metric").withColumn("metric", F.when(F.col("metric") == "view", "RTD").when(F.col("metric") == "click", "cycle_time")), "subfamily"))

# Histogram distances


def _w1(a: str, b: str, keys: str = "", final: str = "round({d}, 6) AS distance", over: str = "") -> str:
    """Wasserstein distance of two SQL queries with columns (keys,) bin."""
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f""", ha AS ({a}), hb AS ({b}), m AS (SELECT {k}bin, sum(x) AS x, sum(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM ha UNION ALL SELECT *, 0, 1 FROM hb) GROUP BY {k}bin),
q AS (SELECT *, sum(x) OVER ({part} ORDER BY bin) AS cx, sum(y) OVER ({part} ORDER BY bin) AS cy, sum(x) OVER ({part}) AS tx, sum(y) OVER ({part}) AS ty, lead(bin) OVER ({part} ORDER BY bin) - bin AS gap FROM m),
d AS (SELECT {k}CASE WHEN max(tx) > 0 AND max(ty) > 0 THEN sum(abs(cx / nullif(tx, 0) - cy / nullif(ty, 0)) * coalesce(gap, 0)) END AS d, max(tx) AS n FROM q {group})
SELECT {final.format(d="avg(d)" if over else "d")} FROM d"""


_H = "3600000000"
_RT = "SELECT CAST(floor((max(t) - cut) / 3600000000) AS BIGINT) AS bin FROM {log}, p GROUP BY case_id, cut"


def _ongoing(x, name):
    return W.cases_in_window(getattr(x, name), W.ongoing_case_ids(getattr(x, name), x.cut), x.cut, HORIZON)


_ON = (
    ", oe AS (SELECT case_id, least(t, fin) AS t FROM e, p WHERE t > cut AND s < fin AND case_id IN (SELECT case_id FROM e"
    " GROUP BY 1 HAVING min(s) < (SELECT cut FROM p) AND max(t) > (SELECT cut FROM p)))"
    ", og AS (SELECT case_id, least(t, fin) AS t FROM g, p WHERE t > cut AND s < fin AND case_id IN (SELECT case_id FROM g"
    " GROUP BY 1 HAVING min(s) < (SELECT cut FROM p) AND max(t) > (SELECT cut FROM p))), xa AS ("
) + _RT.format(log="oe") + "), xb AS (" + _RT.format(log="og") + "), na AS (SELECT count(*) AS n FROM xa), nb AS (SELECT count(*) AS n FROM xb)"
_FA = "SELECT bin FROM xa UNION ALL SELECT 0 FROM na, nb, (SELECT unnest(range(0, greatest((SELECT n FROM nb) - (SELECT n FROM na), 0))))"
_FB = "SELECT bin FROM xb UNION ALL SELECT 0 FROM na, nb, (SELECT unnest(range(0, greatest((SELECT n FROM na) - (SELECT n FROM nb), 0))))"
query("d1_remaining_time", _ON + _w1(_FA, _FB))(lambda x: D.remaining_time(_ongoing(x, "e"), _ongoing(x, "g"), x.cut))
query("d1_remaining_time_normalised", _ON + _w1(_FA, _FB, final="round({d} / (SELECT nullif(greatest((SELECT max(bin) FROM xa), (SELECT max(bin) FROM xb)), 0)), 6) AS distance"))(lambda x: D.remaining_time(_ongoing(x, "e"), _ongoing(x, "g"), x.cut, normalise=True))
_DUR = "SELECT (t - s) // 60000000 AS bin, activity FROM {log}"
query("d2_wasserstein", _w1(_DUR.format(log="e"), _DUR.format(log="g"), "activity", "activity, round({d}, 6) AS distance"))(
    lambda x: D.wasserstein(D._pair(x.e, x.g, lambda y: y.select("activity", D.bin_of(micros("end_time") - micros("start_time"), 60_000_000).alias("bin")), "activity"), "activity").select("activity", "distance")
)
query("d3_emd", _w1("SELECT (t - s) // 60000000 AS bin FROM e", "SELECT (t - s) // 60000000 + 1 AS bin FROM e", final="round({d} * n, 6) AS distance"))(
    lambda x: D.emd(D._pair(x.e, x.e.withColumn("end_time", moment(micros("end_time") + 60_000_000)), lambda y: y.select(D.bin_of(micros("end_time") - micros("start_time"), 60_000_000).alias("bin"))))
)


def _grams(n: int) -> str:
    cols = ", ".join(f"lag(a, {k}) OVER w AS a{k}" for k in range(1, n))
    one = f"""SELECT g FROM (SELECT [{", ".join(f"a{k}" for k in range(n - 1, 0, -1))}, a] AS g, o FROM (SELECT a, {cols}, lag(1, {n - 1}) OVER w AS o FROM
(SELECT case_id, activity AS a, 1 AS k, s, t, id, 0 AS z FROM {{log}} UNION ALL SELECT DISTINCT case_id, '', j, 0, 0, 0, z FROM {{log}}, (SELECT unnest([0, 2]) AS j), (SELECT unnest(range(1, {n})) AS z)) WINDOW w AS (PARTITION BY case_id ORDER BY k, s, t, id, z))) WHERE o = 1"""
    return (
        f", x AS ({one.format(log='e')}), y AS ({one.format(log='g')}), m AS (SELECT g, sum(d) AS d, count(*) AS n"
        f" FROM (SELECT g, 1 AS d FROM x UNION ALL SELECT g, -1 FROM y) GROUP BY g)"
        f" SELECT round(sum(abs(d)) / sum(n), 6) AS distance FROM m"
    )


query("d4_n_gram_3", _grams(3))(lambda x: D.n_gram_distance(x.e, x.g, 3))
query("d4_n_gram_2", _grams(2))(lambda x: D.n_gram_distance(x.e, x.g, 2))
query("d5_absolute_events", _w1(*[f"SELECT s // {_H} AS bin FROM {k}" for k in "eg"]))(lambda x: D.absolute_events(x.e, x.g))
_DAY = "SELECT (isodow(make_timestamp({t})) - 1) AS day, hour(make_timestamp({t})) AS bin FROM {q}"
query("d6_circadian_events", _w1(*[_DAY.format(t="s", q=k) for k in "eg"], "day", "round({d}, 6) AS distance", "x"))(lambda x: D.circadian_events(x.e, x.g))
query("d7_circadian_workforce", _w1(*[_DAY.format(t="h * 3600000000", q=f"(SELECT DISTINCT resource, unnest(range(s // {_H}, t // {_H} + 1)) AS h FROM {k})") for k in "eg"], "day", "round({d}, 6) AS distance", "x"))(lambda x: D.circadian_workforce(x.e, x.g))
query("d8_relative_events", _w1(*[f"SELECT (unnest([s, t]) - f) // {_H} AS bin FROM (SELECT s, t, min(s) OVER (PARTITION BY case_id) AS f FROM {k})" for k in "eg"]))(lambda x: D.relative_events(x.e, x.g))
query("d9_cycle_times", _w1(*[f"SELECT (max(t) - min(s)) // {_H} AS bin FROM {k} GROUP BY case_id" for k in "eg"]))(lambda x: D.cycle_times(x.e, x.g))
query("d10_case_arrivals", _w1(*[f"SELECT min(s) // {_H} AS bin FROM {k} GROUP BY case_id" for k in "eg"]))(lambda x: D.case_arrivals(x.e, x.g))


def _panel() -> str:
    """The metric panel: subsets of both logs, then each distance as a query of its own."""
    subsets = "".join(
        f", b{k} AS (SELECT case_id, min(s) AS f, max(t) AS l"
            f" FROM {k} GROUP BY 1), v{k} AS (SELECT id, case_id, activity, resource, greatest(s, cut) AS s, least(t, fin) AS t"
            f" FROM {k}, p WHERE t >= cut AND s <= fin),"
        f" o{k} AS (SELECT {k}.* FROM {k} JOIN b{k} USING (case_id), p WHERE f < cut AND l > cut AND t > cut), c{k} AS (SELECT {k}.* FROM {k} JOIN b{k} USING (case_id), p WHERE f >= cut AND f <= fin)"
        for k in "eg"
    )
    both = lambda text, p: [text.format(q=p + k) for k in "eg"]
    rest = ", xa AS (" + _RT.format(log="oe") + "), xb AS (" + _RT.format(log="og") + "), na AS (SELECT count(*) AS n FROM xa), nb AS (SELECT count(*) AS n FROM xb)"
    busy = (
        "SELECT (isodow(make_timestamp(h * 3600000000)) - 1) AS day, hour(make_timestamp(h * 3600000000)) AS bin"
        " FROM (SELECT DISTINCT resource, unnest(range(s // 3600000000, t // 3600000000 + 1)) AS h FROM {q})"
    )
    day = "SELECT (isodow(make_timestamp(s)) - 1) AS day, hour(make_timestamp(s)) AS bin FROM {q}"
    found = {
        ("event_filter", "n_gram"): _grams(3).replace("FROM e", "FROM ve").replace("FROM g)", "FROM vg)").replace("FROM g ", "FROM vg ").replace("FROM g,", "FROM vg,"),
        ("event_filter", "absolute_event"): _w1(*both("SELECT s // 3600000000 AS bin FROM {q}", "v")),
        ("event_filter", "circadian_event"): _w1(*both(day, "v"), "day", "round({d}, 6) AS distance", "x"),
        ("event_filter", "circadian_workflow"): _w1(*both(busy, "v"), "day", "round({d}, 6) AS distance", "x"),
        ("ongoing_filter", "RTD"): rest + _w1(_FA, _FB),
        ("complete_filter", "RED"): _w1(*both("SELECT (unnest([s, t]) - f) // 3600000000 AS bin FROM (SELECT s, t, min(s) OVER (PARTITION BY case_id) AS f FROM {q})", "c")),
        ("complete_filter", "cycle_time"): _w1(*both("SELECT (max(t) - min(s)) // 3600000000 AS bin FROM {q} GROUP BY case_id", "c")),
        ("complete_filter", "case_arrival_rate"): _w1(*both("SELECT min(s) // 3600000000 AS bin FROM {q} GROUP BY case_id", "c")),
    }
    rows = [f"SELECT '{f}' AS subfamily, '{m}' AS metric, distance::DOUBLE AS value FROM (WITH {q.removeprefix(', ')})" for (f, m), q in found.items()]
    per = "(SELECT count(*) / nullif(count(DISTINCT case_id), 0) FROM {q})"
    left = "(SELECT avg(r) FROM (SELECT (max(t) - cut) / 1e6 AS r FROM {q}, p GROUP BY case_id, cut))"
    n = "(SELECT count(DISTINCT case_id) FROM {q})"
    more = {
        "avg_remaining_diff": f"abs({left.format(q='oe')} - {left.format(q='og')}) / nullif({left.format(q='oe')}, 0)", "ongoing_cases_count": n.format(q="og"), "ongoing_cases_count_diff": f"abs({n.format(q='oe')} - {n.format(q='og')})",
        "avg_events_per_case": per.format(q="og"), "avg_events_per_case_diff": f"abs({per.format(q='oe')} - {per.format(q='og')})",
    }
    rows += [f"SELECT 'ongoing_filter', '{m}', ({v})::DOUBLE" for m, v in more.items()]
    return subsets + " SELECT subfamily, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(rows) + ")"


@query("d11_metric_panel", _panel())
def _(x):
    return A.metric_panel(W.split_into_subsets(x.e, x.cut, x.end), W.split_into_subsets(x.g, x.cut, x.end), x.cut)


# State metrics

_KEYS = {"activity_case": "to_json([activity, case_id])", "case": "to_json([case_id])", "activity": "to_json([activity])", "activity_role": "to_json([activity, role])", "case_type": "to_json([case_type])", "activity_type": "to_json([activity, case_type])"}


def _sweep(views, a="e", b="g") -> str:
    items = ", ".join(f"{{'v': '{v}', 'k': {_KEYS[v]}::VARCHAR}}" for v in views)
    return f""", i AS (SELECT side, s, t, x.v AS view, x.k AS key FROM (SELECT *, unnest([{items}]) AS x FROM (SELECT 0 AS side, l.*, role FROM {a} l LEFT JOIN r USING (resource) WHERE t > s UNION ALL SELECT 1, l.*, role FROM {b} l LEFT JOIN r USING (resource) WHERE t > s))),
d AS (SELECT view, key, tp, sum(CASE WHEN side = 0 THEN d ELSE 0 END) AS da, sum(CASE WHEN side = 1 THEN d ELSE 0 END) AS db FROM (SELECT view, key, side, s AS tp, 1 AS d FROM i UNION ALL SELECT view, key, side, t, -1 FROM i) GROUP BY ALL),
c AS (SELECT *, sum(da) OVER w AS a, sum(db) OVER w AS b FROM d WINDOW w AS (PARTITION BY view, key ORDER BY tp)),
k AS (SELECT view, tp, sum(least(a, b) - least(a - da, b - db)) AS lo, sum(greatest(a, b) - greatest(a - da, b - db)) AS hi, sum(abs(a - b) - abs(a - da - b + db)) AS ap, sum(da + db) AS tot, sum(da) AS da, sum(db) AS db FROM c GROUP BY ALL),
n AS (SELECT view, tp AS t, lead(tp) OVER w AS next_t, sum(lo) OVER w AS low, sum(hi) OVER w AS high, sum(ap) OVER w AS apart, sum(tot) OVER w AS total, sum(da) OVER w AS a, sum(db) OVER w AS b FROM k WINDOW w AS (PARTITION BY view ORDER BY tp)),
l AS (SELECT view, 'jaccard' AS distance, t, next_t, CASE WHEN high > 0 THEN 1 - low / high ELSE 0 END AS d FROM n UNION ALL SELECT view, 'cardinality', t, next_t, CASE WHEN greatest(a, b) > 0 THEN abs(a - b) / greatest(a, b) ELSE 0 END FROM n)"""


_SUM = " SELECT view, distance, round(sum(d * coalesce(next_t - t, 0)) / {len}, 6) AS summary_distance, round({len} / 1e6, 6) AS total_duration_seconds FROM l GROUP BY view, distance"
_PLAIN = ["activity_case", "case", "activity", "case_type", "activity_type"]
query("m1_sweep_steps", _sweep(["activity"]) + " SELECT view, t, low::BIGINT AS low, high::BIGINT AS high, apart::BIGINT AS apart, total::BIGINT AS total FROM n")(lambda x: M.steps(M.keyed_steps(M.instances(x.e, x.g, ["activity"]))).select("view", "t", "low", "high", "apart", "total"))
query("m2_role_view", _sweep(["activity_role"]) + _SUM.format(len="(max(t) - min(t))"))(lambda x: M.state_distances(x.e, x.g, ["activity_role"], roles=x.roles))
query("m3_m4_timeline", _sweep(["case_type"]) + " SELECT distance, t, round(d, 6) AS d FROM l")(lambda x: M.timeline(M.instances(x.e, x.g, ["case_type"])).select("distance", "t", "d"))
query("m5_state_distance", _sweep(["activity"]) + _SUM.format(len="(max(t) - min(t))") + " HAVING distance = 'jaccard'")(lambda x: M.state_distances(x.e, x.g, ["activity"]).filter("distance = 'jaccard'"))
query("m6_windowed_distance", _sweep(["activity"], "we", "wg").replace(", i AS", (
    ", we AS (SELECT id, case_id, activity, resource, greatest(s, cut) AS s, least(t, fin) AS t, case_type, user_id"
    " FROM e, p WHERE t > cut AND s < fin)"
    ", wg AS (SELECT id, case_id, activity, resource, greatest(s, cut) AS s, least(t, fin) AS t, case_type, user_id FROM g, p"
    " WHERE t > cut AND s < fin), i AS"
), 1) + _SUM.format(len="172800000000"))(
    lambda x: M.state_distances(W.cases_in_window(x.e, None, x.cut, HORIZON), W.cases_in_window(x.g, None, x.cut, HORIZON), ["activity"], window=(x.cut, x.end))
)
query("m7_all_state_distances", _sweep([*_PLAIN, "activity_role"]) + _SUM.format(len="(max(t) - min(t))"))(lambda x: M.state_distances(x.e, x.g, roles=x.roles))


@query("m5_state_distance_deliveries")
def _(x):
    """The larger log against itself with longer lines for some suppliers."""
    a = L.deliveries(x.spark, x.sf_dir)
    return M.state_distances(a, a.withColumn("end_time", F.when(F.col("resource").cast("int") % 5 == 0, moment(micros("end_time") + 12 * HOUR)).otherwise(F.col("end_time"))), ["activity", "case_type"])


SQL["m5_state_distance_deliveries"] = """WITH r AS (SELECT '' AS resource, '' AS role),
e AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity, CAST(l_suppkey AS VARCHAR) AS resource, epoch_us(l_shipdate) AS s, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 3600000000 AS t, o_orderpriority AS case_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT case_id, activity, resource, s, CASE WHEN CAST(resource AS INT) % 5 = 0 THEN t + 43200000000 ELSE t END AS t, case_type FROM e)""" + _sweep(["activity", "case_type"]) + _SUM.format(len="(max(t) - min(t))")
