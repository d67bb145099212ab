"""Queries: mismatch assessment, transforms, features, models, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracework.functions.scalar import HOUR, micros, moment
from tracework.log import case_bounds
from tracework.operators import assess as B
from tracework.operators import experiment as X
from tracework.operators import features as L
from tracework.operators import ladders as LA
from tracework.operators import models as MO
from tracework.operators import ranking as R
from tracework.operators import sweep as M
from tracework.operators import transforms as T
from tracework.operators import windows as W
from tracework.operators.aggregates import aggregate_runs, error_targets, target_activity, utilisation
from tracework.plans.core import _FA, _FB, _RT, _grams, _sweep, _w1
from tracework.plans.base import BASE, DAY, HORIZON, Logs, micros_out, rounded, stored

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = lambda spark, d: rounded(fn(Logs(spark, d)))
        if sql:
            SQL[name] = BASE + sql
        return fn

    return add


# Mismatch assessment


def _events(x, roles=True):
    out = []
    for log in (x.e, x.g):
        # Enabled half an hour before the start for some rows.
        log = log.withColumn("enable_time", F.when(F.col("id") % 4 == 0, moment(micros("start_time") - HOUR // 2)))
        out.append(W.fill_enable(W.normalise_events(log, roles=x.roles if roles else None)[0]))
    return out


def _swept(x, views, role_mapping=False, case_mode="interval"):
    return B.swept(*_events(x), views, role_mapping, case_mode)


def _us(name):
    """Seconds as whole microseconds."""
    return F.round(F.col(name) * 1e6).cast("long")


_V = {
    "activity": "[activity]", "activity_case": "[activity, case_id]", "activity_resource": "[activity, resource]", "activity_case_resource": "[activity, case_id, resource]",
    "resource": "[role]", "activity_role": "[activity, role]", "activity_phase": "[activity, 'processing']",
}


def _assessed(views) -> str:
    rows = "SELECT 0 AS side, l.*, role FROM e l LEFT JOIN r USING (resource) WHERE t > s UNION ALL SELECT 1, l.*, role FROM g l LEFT JOIN r USING (resource) WHERE t > s"
    items = ", ".join(f"{{'v': '{v}', 'k': {_V[v]}}}" for v in views if v != "case") or "{'v': '', 'k': ['']}"
    extra = ""
    if "case" in views:
        extra += " UNION ALL SELECT side, min(s), max(t), 'case', [case_id] FROM o GROUP BY side, case_id"
    if "activity_phase" in views:
        extra += " UNION ALL SELECT side, en, s, 'activity_phase', [activity, 'waiting'] FROM oe WHERE en < s"
    return f""", o AS ({rows}), oe AS (SELECT *, CASE WHEN id % 4 = 0 THEN s - 1800000000 ELSE lag(t) OVER (PARTITION BY side, case_id ORDER BY s, t, id) END AS en FROM o), i AS (SELECT side, s, t, x.v AS view, x.k AS key FROM (SELECT side, s, t, unnest([{items}]) AS x FROM o) WHERE x.v <> ''{extra}),
d AS (SELECT view, key, tp, sum(CASE WHEN side = 0 THEN d ELSE 0 END) AS da, sum(CASE WHEN side = 1 THEN d ELSE 0 END) AS db FROM (SELECT view, key, side, s AS tp, 1 AS d FROM i UNION ALL SELECT view, key, side, t, -1 FROM i) GROUP BY ALL),
c AS MATERIALIZED (SELECT *, sum(da) OVER w AS a, sum(db) OVER w AS b, lead(tp) OVER w AS nx FROM d WINDOW w AS (PARTITION BY view, key ORDER BY tp)),
k AS (SELECT view, tp, sum(abs(a - b) - abs(a - da - b + db)) AS ap, sum(da + db) AS tot FROM c GROUP BY ALL),
n AS (SELECT view, tp AS s, lead(tp) OVER w AS t, sum(ap) OVER w AS ap, sum(tot) OVER w AS tot FROM k WINDOW w AS (PARTITION BY view ORDER BY tp)),
l AS (SELECT *, (t - s) / 1e6 AS dur, CASE WHEN tot > 0 THEN ap / tot ELSE 0 END AS dist FROM n WHERE t IS NOT NULL),
f AS MATERIALIZED (SELECT view, s, coalesce(sum(CASE WHEN tot > 0 THEN (t - s) / 1e6 / tot ELSE 0 END) OVER (PARTITION BY view ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM n),
q AS (SELECT c.view, c.key, sum(abs(a - b) * (f2.f - f1.f)) AS contribution FROM c JOIN f f1 ON c.view || ':' || c.tp = f1.view || ':' || f1.s JOIN f f2 ON c.view || ':' || c.nx = f2.view || ':' || f2.s WHERE a <> b GROUP BY ALL)"""


_SCORE = " SELECT view, round(sum(dist * dur) / sum(dur), 6) AS overall_score FROM l GROUP BY view"
query("b1_b6_scores", _assessed(B.VIEWS) + _SCORE)(lambda x: B.swept_scores(_swept(x, list(B.VIEWS), True)))
query("b2_case_running", _assessed(["activity_case"]).replace("'activity_case'", "'case'").replace("[activity, case_id]", "[case_id]") + _SCORE)(lambda x: B.swept_scores(_swept(x, ["case"], case_mode="running")))
query("b3_phase_intervals", _assessed(["activity_phase"]) + " SELECT key[1] AS activity, key[2] AS phase, side, count(*) AS n, round(sum((t - s) / 1e6), 3) AS seconds FROM i GROUP BY ALL")(
    lambda x: B.intervals(*_events(x), ["activity_phase"]).groupBy(F.col("key")[0].alias("activity"), F.col("key")[1].alias("phase"), "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("t") - F.col("s")), 3).alias("seconds"))
)
@query(
    "b4_default_views",
    _assessed(["activity"]) + (
        ", f0 AS (SELECT bool_or(en < s) AS has FROM oe)"
        ", v AS (SELECT unnest(['activity', 'activity_case', 'activity_resource', 'activity_case_resource', 'resource', 'case', 'activity_role', 'activity_phase']) AS view)"
        " SELECT 'all' AS wanted, view FROM v, f0 WHERE view <> 'activity_phase' OR has UNION ALL SELECT 'no roles', view"
        " FROM v, f0 WHERE view <> 'activity_role' AND (view <> 'activity_phase' OR has) UNION ALL SELECT 'no enable times', view"
        " FROM v WHERE view <> 'activity_phase' UNION ALL SELECT 'named', view FROM v WHERE view IN ('activity_role', 'case')"
    ),
)
def _(x):
    a, b = _events(x)
    bare = [y.withColumn("enable", F.lit(None).cast("double")) for y in (a, b)]
    wanted = {"all": B.select_views(None, a, b, True), "no roles": B.select_views(None, a, b, False), "no enable times": B.select_views(None, *bare, True), "named": B.select_views([" Activity-Role ", "CASE", "nonsense"], a, b, True)}
    return x.spark.createDataFrame([(k, v) for k, vs in wanted.items() for v in vs], "wanted string, view string")


query("b5_change_points", _assessed(["activity", "case"]) + " SELECT view, count(*) AS n FROM (SELECT DISTINCT view, tp FROM d) GROUP BY 1")(
    lambda x: _swept(x, ["activity", "case"]).steps.groupBy("view").agg(F.count(F.lit(1)).alias("n"))
)
query("b6_timeline", _assessed(["activity_role"]) + " SELECT s, round(dist, 6) AS distance, CAST(dur AS BIGINT) AS duration FROM l")(
    lambda x: B.timeline(_swept(x, ["activity_role"], True)).select(_us("start").alias("s"), "distance", F.rint((_us("end") - _us("start")) / 1e6).cast("long").alias("duration"))
)
query("b7_contributors", _assessed(["activity", "resource"]) + (
    ", z AS (SELECT view, sum(contribution) AS a FROM q GROUP BY 1)"
    " SELECT view, array_to_string(key, '|') AS key, round(contribution, 2) AS contribution, round(contribution / a, 5) AS share"
    " FROM q JOIN z USING (view)"
))(
    lambda x: B.contributors(_swept(x, ["activity", "resource"], True)).select("view", F.array_join("key", "|").alias("key"), F.round("contribution", 2).alias("contribution"), F.round("share", 5).alias("share"))
)


@query("b8_interval_contributors", _assessed(["activity"]) + (
    ", m AS (SELECT l.s, l.tot, c.key, abs(a - b) AS u, row_number() OVER (PARTITION BY l.s ORDER BY abs(a - b) DESC, c.key) AS rank"
    " FROM l JOIN c ON c.view = l.view AND c.tp <= l.s AND c.nx > l.s WHERE a <> b)"
    " SELECT s, rank, key[1] AS key, round(u / tot, 6) AS share FROM m WHERE rank <= 2"
))
def _(x):
    return B.interval_contributors(_swept(x, ["activity"]), 2).select(F.round(F.col("start") * 1e6).cast("long").alias("s"), "rank", F.col("key")[0].alias("key"), "share")


_RANKED = (
    ", sc AS (SELECT view, sum(dist * dur) / sum(dur) AS score FROM l GROUP BY view)"
    ", rq AS (SELECT q.*, row_number() OVER (PARTITION BY view ORDER BY round(contribution, 4) DESC, key) AS rank, contribution / sum(contribution) OVER (PARTITION BY view) AS share"
    " FROM q)"
)


def _assess(x):
    logs = [y.withColumn("enable_time", F.when(F.col("id") % 4 == 0, moment(micros("start_time") - HOUR // 2))) for y in (x.e, x.g)]
    return B.assess(*logs, roles=x.roles)


@query("b_assessment", _assessed(B.VIEWS) + _RANKED + (
    " SELECT view, round(score, 6) AS overall_score, row_number() OVER (ORDER BY score DESC, view) AS rank, n AS contributors, round(c, 2) AS contribution"
    " FROM sc JOIN (SELECT view, count(*) AS n, sum(contribution) AS c FROM q GROUP BY 1) USING (view)"
))
def _(x):
    """The assessment in one call, all default views: each view's score, rank and contributors."""
    found = _assess(x)
    parts = found["parts"].groupBy("view").agg(F.count(F.lit(1)).alias("contributors"), F.round(F.sum("contribution"), 2).alias("contribution"))
    return found["scores"].join(parts, "view").select("view", "overall_score", "rank", "contributors", "contribution")


query("o3_top_views", _assessed(["activity", "case", "resource"]) + _RANKED + " SELECT view, rank FROM (SELECT view, row_number() OVER (ORDER BY score DESC, view) AS rank FROM sc) WHERE rank <= 2")(
    lambda x: B.top_views(B.swept_scores(_swept(x, ["activity", "case", "resource"], True)), 2).select("view", "rank")
)
query("o3_top_intervals", _assessed(["activity", "resource"]) + (
    " SELECT view, s, round(c, 2) AS contribution"
    " FROM (SELECT view, s, dist * dur AS c, row_number() OVER (PARTITION BY view ORDER BY dist * dur DESC, s) AS rank"
    " FROM l) WHERE rank <= 20"
))(
    lambda x: B.top_intervals(B.timeline(_swept(x, ["activity", "resource"], True)), 20).select("view", F.round(F.col("start") * 1e6).cast("long").alias("s"), F.round("contribution", 2).alias("contribution"))
)
query("o4_ranked_contributors", _assessed(["activity", "activity_resource"]) + _RANKED + " SELECT view, rank, array_to_string(key, '|') AS key FROM rq WHERE rank <= 5")(
    lambda x: B.ranked(B.contributors(_swept(x, ["activity", "activity_resource"], True)), 5).select("view", "rank", F.array_join("key", "|").alias("key"))
)


_SAID = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.PARTS.items()) + " END"
_TEXT = f""", b9 AS (SELECT view, score, row_number() OVER (ORDER BY score DESC, view) AS rank FROM sc),
nm AS (SELECT view, string_agg(array_to_string(key, ' | ') || ' (' || printf('%.4f', contribution) || ')', ', ' ORDER BY rank) AS names FROM rq WHERE rank <= 3 GROUP BY 1)
SELECT rank::INT AS rank, view || ': overall ' || printf('%.4f', score) || ', the logs differ in ' || array_to_string(list_transform(string_split(view, '_'), lambda p: {_SAID}), ' and ')
  || coalesce('; mainly ' || names, '') AS line FROM b9 LEFT JOIN nm USING (view) WHERE rank <= 3"""


@query("b9_interpretation", _assessed(["activity", "activity_resource", "case", "resource"]) + _RANKED + _TEXT)
def _(x):
    found = _swept(x, ["activity", "activity_resource", "case", "resource"], True)
    return B.interpretation(B.swept_scores(found), B.contributors(found))


# Transforms

_MD5 = "md5('{seed}:' || {c})"
_U = "(('0x' || substr(md5('{seed}:' || {c}), 1, 8))::BIGINT / 4294967296.0)"
OUT = ["id", "case_id", "activity", "resource", "start_time", "end_time", "case_type"]
_ROW = "id, case_id, {activity} AS activity, {resource} AS resource, {s} AS start_time, {t} AS end_time, {case_type} AS case_type"


def _cols(**new) -> str:
    return _ROW.format(**({"activity": "activity", "resource": "resource", "s": "s", "t": "t", "case_type": "case_type"} | new))


def out(df):
    return micros_out(df.select(*OUT))


query(
    "t1_relabel_fraction",
    ", k AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY " + _MD5.format(seed="relabel", c="id") + ", id) AS rn, count(*) OVER () AS n FROM e WHERE activity = 'view') WHERE rn <= round_even(0.3 * n, 0)) SELECT " + _cols(activity="CASE WHEN id IN (SELECT id FROM k) THEN 'other' ELSE activity END") + " FROM e",
)(lambda x: out(T.relabel_fraction(x.e, "view", "other", 0.3)))
query(
    "t2_rephase_cases",
    (
        ", b AS (SELECT case_id, least(7200000000, greatest(min(s) - cut, 0)) AS lo, least(7200000000, greatest(fin - max(t), 0)) AS hi"
        " FROM e, p GROUP BY case_id, cut, fin), o AS (SELECT case_id, CAST(floor("
    ) + _U.format(seed="rephase", c="case_id") + " * (lo + hi) - lo) AS BIGINT) AS d FROM b) SELECT " + _cols(s="s + d", t="t + d") + " FROM e JOIN o USING (case_id)",
)(lambda x: out(T.rephase_cases(x.e, 2, x.cut, x.end)))
_PICK = "(SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY md5('mix-{tag}:' || case_id), case_id) AS rn FROM (SELECT DISTINCT '{p}' || case_id AS case_id FROM {log})) WHERE rn <= {n})"
query(
    "t3_merge_at_ratio",
    (
        ", z AS (SELECT id, 'g_' || case_id AS case_id, activity, resource, s, t, 'green' AS case_type FROM e UNION ALL"
        " SELECT id, 'r_' || case_id, activity, resource, s, t, 'red' FROM g) SELECT "
    ) + _cols() + " FROM z WHERE case_id IN " + _PICK.format(tag="green", p="g_", log="e", n=30) + " OR case_id IN " + _PICK.format(tag="red", p="r_", log="g", n=70),
)(lambda x: out(T.merge_at_ratio(x.e, x.g, 0.3, 100)))
_TAG = ", y AS (SELECT case_id, arg_min(case_type, {'s': s, 'id': id}) AS tag, min(s) AS f FROM e GROUP BY 1)"
query(
    "t4_swap_case_types",
    _TAG + (
        ", n AS (SELECT CAST(floor(0.4 * least(count(*) FILTER (tag = 'blue'), count(*) FILTER (tag = 'red'))) AS BIGINT) AS n"
        " FROM y), k AS (SELECT case_id FROM (SELECT case_id, row_number() OVER (PARTITION BY tag ORDER BY md5(CASE WHEN tag = 'blue' THEN 'swap-a:' ELSE 'swap-b:' END || case_id), case_id) AS rn"
        " FROM y), n WHERE rn <= n) SELECT "
    )
    + _cols(case_type="CASE WHEN case_id IN (SELECT case_id FROM k) THEN CASE case_type WHEN 'blue' THEN 'red' ELSE 'blue' END ELSE case_type END") + " FROM e",
)(lambda x: out(T.swap_case_types(x.e, 0.4)))
query(
    "t5_drift_case_types",
    _TAG + (
        ", k AS (SELECT case_id, tag, row_number() OVER (ORDER BY f, case_id) AS pos"
        " FROM (SELECT *, row_number() OVER (ORDER BY md5('drift:' || case_id), case_id) AS rn, count(*) OVER () AS n FROM y)"
        " WHERE rn <= round_even(0.5 * n, 0)), h AS (SELECT count(*) AS c FROM k WHERE tag = (SELECT min(tag) FROM k))"
        ", w AS (SELECT tag, row_number() OVER (ORDER BY pos) + (SELECT c FROM h) AS pos FROM k WHERE tag <> (SELECT min(tag)"
        " FROM k)), v AS (SELECT k.case_id, CASE WHEN k.pos <= (SELECT c FROM h) THEN (SELECT min(tag)"
        " FROM k) ELSE w.tag END AS new FROM k LEFT JOIN w USING (pos)) SELECT "
    )
    + _cols(case_type="CASE WHEN v.case_id IS NOT NULL THEN v.new ELSE case_type END") + " FROM e LEFT JOIN v USING (case_id)",
)(lambda x: out(T.drift_case_types(x.e, 0.5)))
query("t7_scale_durations", " SELECT " + _cols(t="s + CAST(floor((t - s) * 1.5) AS BIGINT)") + " FROM e")(lambda x: out(T.scale_durations(x.e, 1.5)))


def _specialised(x):
    """(log, roles): the whole log with a team of three for each activity; the teams of click and view are one role."""
    log = x.e.withColumn("resource", F.concat("activity", F.lit("-"), (F.col("id") % 3).cast("string")))
    return log, log.select("resource", F.when(F.col("activity").isin("click", "view"), "desk").otherwise("field").alias("role")).distinct()


query("t8_swap_roles", (
    ", w AS (SELECT list(DISTINCT activity || '-' || id % 3 ORDER BY activity || '-' || id % 3) AS l FROM e"
    " WHERE activity NOT IN ('click', 'view')) SELECT "
) + _cols(resource="CASE WHEN activity IN ('click', 'view') THEN l[id % len(l) + 1] ELSE activity || '-' || id % 3 END") + " FROM e, w")(
    lambda x: (lambda log, roles: out(T.swap_roles(log, roles, "desk", "field", 2)))(*_specialised(x))
)
query("t9_shift_clock", ", k AS (SELECT resource FROM r WHERE role = 'role1') SELECT " + _cols(s="s + CASE WHEN resource IN (SELECT resource FROM k) THEN 10800000000 ELSE 0 END", t="t + CASE WHEN resource IN (SELECT resource FROM k) THEN 10800000000 ELSE 0 END") + " FROM e")(lambda x: out(T.shift_clock(x.e, 3, x.roles, "role1")))
query("t9_shift_all_clocks", " SELECT " + _cols(s="s - 5400000000", t="t - 5400000000") + " FROM e")(lambda x: out(T.shift_clock(x.e, -1.5)))
query("t10_automate", " SELECT " + _cols(t="CASE WHEN activity IN ('view', 'error') THEN s + greatest(CAST(floor((t - s) * 0.25) AS BIGINT), 1000000) ELSE t END") + " FROM e")(lambda x: out(T.automate(x.e, ["view", "error"], 75)))
_LAY = (
    ", v AS (SELECT *, s + coalesce(sum(len - (t - s)) OVER (PARTITION BY case_id ORDER BY s, t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ns"
    " FROM u) SELECT "
) + _cols(s="CAST(ns AS BIGINT)", t="CAST(ns + len AS BIGINT)") + " FROM v"
query(
    "t11_front_back_load",
    (
        ", a AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n, t - s AS d"
        " FROM e WINDOW w AS (PARTITION BY case_id ORDER BY s, t, id))"
        ", b AS (SELECT *, d * CASE WHEN n > 1 THEN 1 + 0.5 * (1 - 2 * i / greatest(n - 1, 1)) ELSE 1 END AS wt FROM a)"
        ", c AS (SELECT *, CAST(round(coalesce(sum(wt) OVER (PARTITION BY case_id ORDER BY s, t, id) * (sum(d) OVER (PARTITION BY case_id) / nullif(sum(wt) OVER (PARTITION BY case_id), 0)), 0)) AS BIGINT) AS cu"
        " FROM b), u AS (SELECT *, CASE WHEN n > 1 THEN cu - coalesce(lag(cu) OVER (PARTITION BY case_id ORDER BY s, t, id), 0) ELSE d END AS len"
        " FROM c)"
    ) + _LAY,
)(lambda x: out(T.front_back_load(x.e, 0.5)))
query(
    "t12_swap_profiles",
    (
        ", m AS (SELECT activity, avg(t - s) AS m FROM e GROUP BY 1)"
        ", o AS (SELECT unnest([{'a': 'view', 'b': 'error'}, {'a': 'click', 'b': 'signup'}, {'a': 'error', 'b': 'view'}, {'a': 'signup', 'b': 'click'}]) AS o)"
        ", h AS (SELECT o.a AS activity, ((1 - 0.6) * m1.m + 0.6 * m2.m) / m1.m AS f FROM o JOIN m m1 ON m1.activity = o.a"
        " JOIN m m2 ON m2.activity = o.b), u AS (SELECT e.*, CAST(floor((t - s) * coalesce(f, 1.0)) AS BIGINT) AS len FROM e LEFT"
        " JOIN h USING (activity))"
    ) + _LAY,
)(lambda x: out(T.swap_profiles(x.e, ["view", "click"], ["error", "signup"], 60)))


def _ladder(x, levels=(0, 25, 50, 100), replicates=2):
    """Levels times replicates of a relabelling, compared with the log as it was, in the window: rows as results tables have them."""
    window = (x.cut, x.end)
    base = W.cases_in_window(x.e, None, x.cut, HORIZON)
    activity = target_activity(W.cases_in_window(x.e, W.ongoing_case_ids(x.e, x.cut), x.cut, HORIZON), base).first()["activity"]
    found = None
    for level in levels:
        for k in range(replicates):
            new = T.relabel_fraction(base, activity, "changed", level / 100, f"ladder-{k}")
            part = M.instances(base, new, ["activity", "case"]).withColumn("view", F.concat(F.lit(f"{level}:{k}:"), F.col("view")))
            found = part if found is None else found.unionByName(part)
    got = M.summary(M.timeline(found, whole=False), window)  # one sweep for the whole ladder
    part = F.split("view", ":")
    return got.select(part[0].cast("int").alias("level"), part[1].cast("int").alias("k_sim"), F.lit("B").alias("scope"), F.lit("state").alias("family"), F.concat(part[2], F.lit("."), F.col("distance")).alias("metric"), F.col("summary_distance").alias("value"))




# Ladders: each transform at level 0 and at one more, in the window; scope A has the cases that are ongoing at the cut, B all.


def _scoped(x, log, ids=None):
    return W.cases_in_window(log, ids, x.cut, HORIZON)


def _transformed(x, name: str, level: int):
    """The log of a ladder's step before it is cut to the window."""
    if name == "swap":
        return T.swap_case_types(x.e, level / 100)
    if name == "drift":
        return T.drift_case_types(x.e, level / 100)
    n = x.e.select("case_id").distinct().count()
    return T.merge_at_ratio(x.e, x.g, 0.5 + level / 100, n // 2)


def _steps(x, name: str, level: int):
    """(level, replicate, scope, reference, altered) for level 0 and the given one."""
    ids = W.ongoing_case_ids(x.e, x.cut)
    if name == "relabel":
        scopes = {"A": _scoped(x, x.e, ids), "B": _scoped(x, x.e)}
        activity = target_activity(*scopes.values()).first()["activity"]
        return [(v, 0, s, log, T.relabel_fraction(log, activity, "changed", v / 100)) for v in (0, level) for s, log in scopes.items()]
    if name == "rephase":  # after the log is cut to the window
        base = _scoped(x, x.e, ids)
        return [(v, 0, "A", base, T.rephase_cases(base, v, x.cut, x.end)) for v in (0, level)]
    out = []
    for v in (0, level):
        base, new = (_transformed(x, name, 0), _transformed(x, name, v)) if name == "mix" else (x.e, _transformed(x, name, v))
        own = [W.ongoing_case_ids(y, x.cut) for y in (base, new)] if name == "mix" else [ids, ids]
        out.append((v, 0, "A", _scoped(x, base, own[0]), _scoped(x, new, own[1])))
    return out


_WROW = "id, case_id, activity, resource, greatest(s, cut) AS s, least(t, fin) AS t, case_type, user_id"
_WIN = "SELECT " + _WROW + " FROM {log}, p WHERE t > cut AND s < fin"
_ONG = "(SELECT case_id FROM {log}, p GROUP BY case_id, cut HAVING min(s) < cut AND max(t) > cut)"


def _ladder_sql(ctes: str, steps: dict[str, tuple[str, str]], views: list[str]) -> str:
    """SQL of a ladder: tables for the steps' logs, and (reference, altered) tables by the step's name `level:k:scope`."""
    a, b = (" UNION ALL ".join(f"SELECT '{k}' AS grp, * FROM {v[i]}" for k, v in steps.items()) for i in (0, 1))
    sweep = _sweep(views, "la", "lb").replace("x.v AS view", "grp || ':' || x.v AS view")
    return ctes + f", la AS ({a}), lb AS ({b})" + sweep + (
        " SELECT split_part(view, ':', 1)::INT AS level, split_part(view, ':', 2)::INT AS k_sim, split_part(view, ':', 3) AS scope, 'state' AS family, split_part(view, ':', 4) || '.' || distance AS metric, round(sum(d * coalesce(next_t - t, 0)) / 172800000000, 6) AS value"
        " FROM l GROUP BY view, distance"
    )


_A = _WIN.format(log="e") + " AND case_id IN " + _ONG.format(log="e")
_SIX = ["activity_case", "case", "activity", "case_type", "activity_type", "activity_role"]
_RELABEL = (
    ", {n} AS (SELECT id, case_id, CASE WHEN rn <= round_even(0.3 * c, 0) AND activity = (SELECT activity"
    " FROM ta) THEN 'changed' ELSE activity END AS activity, resource, s, t, case_type, user_id"
    " FROM (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY md5('relabel:' || id), id) AS rn, count(*) OVER (PARTITION BY activity) AS c"
    " FROM {w}))"
)
_SQL_OF = {
    "relabel": (
        30,
        _ladder_sql(
            (
                f", wa AS ({_A}), wb AS ({_WIN.format(log='e')}), ta AS (SELECT coalesce((SELECT activity FROM wa"
                f" WHERE activity IN (SELECT activity FROM wb) GROUP BY 1 ORDER BY count(*) DESC, activity LIMIT 1), (SELECT activity"
                f" FROM wb GROUP BY 1 ORDER BY count(*) DESC, activity LIMIT 1)) AS activity)"
            ) + _RELABEL.format(n="na", w="wa") + _RELABEL.format(n="nb", w="wb"),
            {"0:0:A": ("wa", "wa"), "0:0:B": ("wb", "wb"), "30:0:A": ("wa", "na"), "30:0:B": ("wb", "nb")}, _SIX,
        ),
    ),
    "rephase": (
        2,
        _ladder_sql(
            (
                f", wa AS ({_A}), bo AS (SELECT case_id, least(7200000000, greatest(min(s) - cut, 0)) AS lo, least(7200000000, greatest(fin - max(t), 0)) AS hi"
                f" FROM wa, p GROUP BY case_id, cut, fin), of AS (SELECT case_id, CAST(floor("
            ) + _U.format(seed="rephase", c="case_id") + (
                " * (lo + hi) - lo) AS BIGINT) AS d FROM bo)"
                ", na AS (SELECT id, case_id, activity, resource, s + d AS s, t + d AS t, case_type, user_id FROM wa"
                " JOIN of USING (case_id))"
            ),
            {"0:0:A": ("wa", "wa"), "2:0:A": ("wa", "na")}, _SIX,
        ),
    ),
    "swap": (
        40,
        _ladder_sql(
            f", wa AS ({_A})" + _TAG + (
                ", sn AS (SELECT CAST(floor(0.4 * least(count(*) FILTER (tag = 'blue'), count(*) FILTER (tag = 'red'))) AS BIGINT) AS n"
                " FROM y), sk AS (SELECT case_id"
                " FROM (SELECT case_id, row_number() OVER (PARTITION BY tag ORDER BY md5(CASE WHEN tag = 'blue' THEN 'swap-a:' ELSE 'swap-b:' END || case_id), case_id) AS rn"
                " FROM y), sn WHERE rn <= n), na AS (SELECT * REPLACE (CASE WHEN case_id IN (SELECT case_id"
                " FROM sk) THEN CASE case_type WHEN 'blue' THEN 'red' ELSE 'blue' END ELSE case_type END AS case_type) FROM wa)"
            ),
            {"0:0:A": ("wa", "wa"), "40:0:A": ("wa", "na")}, _SIX,
        ),
    ),
    "drift": (
        50,
        _ladder_sql(
            f", wa AS ({_A})" + _TAG + ", rk AS (SELECT case_id, tag, f"
                " FROM (SELECT *, row_number() OVER (ORDER BY md5('drift:' || case_id), case_id) AS rn, count(*) OVER () AS cn FROM y)"
                " WHERE rn <= round_even(0.5 * cn, 0))"
            ", ps AS (SELECT *, row_number() OVER (ORDER BY f, case_id) AS pos, min(tag) OVER () AS early FROM rk), qs AS (SELECT *, count(*) FILTER (tag = early) OVER () AS ne FROM ps)"
            ", lt AS (SELECT tag AS later, ne + row_number() OVER (ORDER BY pos) AS pos FROM qs WHERE tag <> early)"
                ", nw AS (SELECT case_id, CASE WHEN pos <= ne THEN early ELSE later END AS new FROM qs LEFT JOIN lt USING (pos))"
            ", na AS (SELECT wa.* REPLACE (CASE WHEN nw.case_id IS NOT NULL THEN nw.new ELSE case_type END AS case_type) FROM wa LEFT JOIN nw USING (case_id))",
            {"0:0:A": ("wa", "wa"), "50:0:A": ("wa", "na")}, _SIX,
        ),
    ),
    "mix": (
        20,
        _ladder_sql(
            ", gr AS MATERIALIZED (SELECT * REPLACE ('g_' || case_id AS case_id, 'green' AS case_type) FROM e)"
                ", rd AS MATERIALIZED (SELECT * REPLACE ('r_' || case_id AS case_id, 'red' AS case_type) FROM g)"
            ", nc AS (SELECT count(DISTINCT case_id) // 2 AS cn FROM e)"
            f", wx AS MATERIALIZED ({_WIN.format(log='gr')} AND case_id IN {_ONG.format(log='gr')} UNION ALL {_WIN.format(log='rd')} AND case_id IN {_ONG.format(log='rd')})"
            ", rk AS MATERIALIZED (SELECT case_id, true AS green, row_number() OVER (ORDER BY md5('mix-green:' || case_id), case_id) AS rn"
                " FROM (SELECT DISTINCT case_id FROM gr) UNION ALL"
                " SELECT case_id, false, row_number() OVER (ORDER BY md5('mix-red:' || case_id), case_id) FROM (SELECT DISTINCT case_id"
                " FROM rd))"
            + "".join((
                f", {t} AS (SELECT wx.* FROM wx JOIN rk USING (case_id), nc"
                f" WHERE rn <= CASE WHEN green THEN round_even({v} * cn, 0) ELSE cn - round_even({v} * cn, 0) END)"
            ) for t, v in (("m0", 0.5), ("m1", 0.7))),
            {"0:0:A": ("m0", "m0"), "20:0:A": ("m0", "m1")}, _SIX,
        ),
    ),
}
_LADDER_SQL = (
    f", wa AS ({_A}), wb AS ({_WIN.format(log='e')}), ta AS (SELECT coalesce((SELECT activity FROM wa"
        f" WHERE activity IN (SELECT activity FROM wb) GROUP BY 1 ORDER BY count(*) DESC, activity LIMIT 1), (SELECT activity"
        f" FROM wb GROUP BY 1 ORDER BY count(*) DESC, activity LIMIT 1)) AS activity)"
    ", st AS (SELECT * FROM (SELECT unnest([0, 25, 50, 100]) AS level), (SELECT unnest([0, 1]) AS rep))"
    ", rk AS (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY md5('ladder-' || rep || ':' || id), id::VARCHAR) AS rn, count(*) OVER (PARTITION BY rep) AS cn"
        " FROM wb JOIN ta USING (activity), (SELECT unnest([0, 1]) AS rep))"
    ", la AS (SELECT level || ':' || rep AS grp, wb.* FROM wb, st)"
        ", lb AS (SELECT level || ':' || rep AS grp, wb.* REPLACE (CASE WHEN rn <= round_even(level / 100.0 * cn, 0) THEN 'changed' ELSE activity END AS activity)"
        " FROM wb CROSS JOIN st LEFT JOIN rk USING (rep, id))"
    + _sweep(["activity", "case"], "la", "lb").replace("x.v AS view", "grp || ':' || x.v AS view")
    + (
        " SELECT split_part(view, ':', 1)::INT AS level, split_part(view, ':', 2)::INT AS k_sim, 'B' AS scope, 'state' AS family, split_part(view, ':', 3) || '.' || distance AS metric, round(sum(d * coalesce(next_t - t, 0)) / 172800000000, 6) AS value"
        " FROM l GROUP BY view, distance"
    )
)
query("t6_m8_ladder", _LADDER_SQL)(_ladder)
for _name, (_level, _sql) in _SQL_OF.items():
    query(f"t6_ladder_{_name}", _sql)(lambda x, n=_name, v=_level: X.ladder(_steps(x, n, v), (x.cut, x.end), x.roles))


# Whole ladders: three levels times five replicates, state rows and baselines, in one plan a flow.

_REPLICATES = 5
_COLS = "id, case_id, {activity} AS activity, resource, {s} AS s, {t} AS t, {case_type} AS case_type, user_id"


def _altered(**new) -> str:
    return _COLS.format(**({"activity": "activity", "s": "s", "t": "t", "case_type": "case_type"} | new))


def _whole_ladder_sql(levels: list, ctes: str, la: str, lb: str, k_baseline: str = "0") -> str:
    """Rows of all steps: la and lb are queries of the compared logs with level, k and scope, over the tables of ctes and st (level, k)."""
    grp = "level || ':' || k || ':' || scope AS grp"
    values = ", ".join(f"{float(v)}::DOUBLE" for v in levels)
    head = f", st AS (SELECT * FROM (SELECT unnest([{values}]) AS level), (SELECT unnest(range({_REPLICATES})) AS k))" + ctes
    head += f", la AS MATERIALIZED (SELECT {grp}, * FROM ({la})), lb AS MATERIALIZED (SELECT {grp}, * FROM ({lb}))"
    sweep = _sweep(_SIX, "la", "lb").replace("x.v AS view", "grp || ':' || x.v AS view")
    state = """SELECT array_to_string(string_split(view, ':')[1:3], ':') AS grp, 'state' AS family,
      CASE WHEN distance = 'jaccard' THEN split_part(view, ':', 4) || '.jaccard' ELSE 'cardinality' END AS metric, sum(d * coalesce(next_t - t, 0)) / 172800000000 AS value
      FROM l WHERE distance = 'jaccard' OR view LIKE '%:activity' GROUP BY view, distance"""
    grams = """SELECT grp, g, side FROM (SELECT grp, side, [lag(a) OVER w, a] AS g, lag(1) OVER w AS o FROM (
        SELECT grp, 1 AS side, case_id, activity AS a, 1 AS j, s, t, id FROM la UNION ALL SELECT DISTINCT grp, 1, case_id, '', j, 0, 0, 0 FROM la, (SELECT unnest([0, 2]) AS j)
        UNION ALL SELECT grp, -1, case_id, activity, 1, s, t, id FROM lb UNION ALL SELECT DISTINCT grp, -1, case_id, '', j, 0, 0, 0 FROM lb, (SELECT unnest([0, 2]) AS j))
      WINDOW w AS (PARTITION BY grp, side, case_id ORDER BY j, s, t, id)) WHERE o = 1"""
    ngd = f"""SELECT grp, CASE WHEN sum(x) > 0 AND sum(y) > 0 THEN sum(abs(d)) / sum(n) END AS v
      FROM (SELECT grp, g, sum(side) AS d, count(*) AS n, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = -1) AS y FROM ({grams}) GROUP BY 1, 2) GROUP BY 1"""
    spans = "(SELECT grp, case_id, min(s) AS f, max(t) AS l FROM {k} GROUP BY 1, 2)"
    left = "SELECT grp, CAST(floor((l - cut) / 3600000000) AS BIGINT) AS bin FROM " + spans + ", p"
    count = "(SELECT count(*) FROM {k} AS n WHERE n.grp = z.grp)"
    filled = "SELECT grp, bin FROM {own} UNION ALL SELECT grp, 0 FROM (SELECT grp, unnest(range(0, greatest(" + count.format(k="{other}") + " - " + count.format(k="{own}") + ", 0))) FROM (SELECT DISTINCT grp FROM st_grp) AS z)"
    bins = {
        "red": [f"SELECT grp, (unnest([s, t]) - f) // 3600000000 AS bin FROM {k} JOIN {spans.format(k=k)} USING (grp, case_id)" for k in ("la", "lb")],
        "cycle_time": [f"SELECT grp, (l - f) // 3600000000 AS bin FROM {spans.format(k=k)}" for k in ("la", "lb")],
        "rtd": [filled.format(own="ra", other="rb"), filled.format(own="rb", other="ra")],
    }
    sweep += f", ra AS MATERIALIZED ({left.format(k='la')}), rb AS MATERIALIZED ({left.format(k='lb')}), st_grp AS MATERIALIZED (SELECT grp FROM la UNION SELECT grp FROM lb)"
    parts = [state, f"SELECT grp, 'baseline', 'ngd_n2', v FROM ({ngd})"]
    parts += [f"SELECT grp, 'baseline', '{m}', v FROM (WITH {_w1(*pair, 'grp', 'grp, {d} AS v').removeprefix(', ')})" for m, pair in bins.items()]
    k = "split_part(grp, ':', 2)::INT"
    return head + sweep + (
        f" SELECT split_part(grp, ':', 1)::DOUBLE AS level, {k_baseline.format(k=k)} AS k_baseline, {k} AS k_sim, split_part(grp, ':', 3) AS scope, family, metric, round(value, 6) AS value"
        f" FROM ("
    ) + " UNION ALL ".join(parts) + ")"


_ONE_A = f", wa AS (SELECT 'A' AS scope, * FROM ({_A}))"
_EACH = "SELECT level, k, scope, " + _altered() + " FROM wa, st"
_TAGGED = "SELECT level, k, scope, " + _altered(case_type="CASE WHEN nw.case_id IS NOT NULL THEN nw.new ELSE case_type END") + " FROM wa CROSS JOIN st LEFT JOIN nw USING (level, k, case_id)"
_MOVED = "CAST(floor((('0x' || substr(md5('rephase:' || k || ':' || case_id), 1, 8))::BIGINT / 4294967296.0) * (lo + hi) - lo) AS BIGINT)"
_DRAWN_MIX = """SELECT level, k, case_id FROM (SELECT k, case_id, row_number() OVER (PARTITION BY k ORDER BY md5('mix-{tag}-' || k || ':' || case_id), case_id) AS rn
  FROM (SELECT DISTINCT case_id FROM {log}), (SELECT DISTINCT k FROM st)), nl WHERE rn <= {n}"""
_WHOLE = {
    "relabel": ([0, 30, 60], _whole_ladder_sql(
        [0, 30, 60],
        f", sc AS MATERIALIZED (SELECT 'A' AS scope, * FROM ({_A}) UNION ALL SELECT 'B', * FROM ({_WIN.format(log='e')}))"
        ", ta AS (SELECT coalesce((SELECT activity FROM sc WHERE scope = 'A' AND activity IN (SELECT activity FROM sc"
            " WHERE scope = 'B') GROUP BY 1 ORDER BY count(*) DESC, activity LIMIT 1), (SELECT activity FROM sc WHERE scope = 'B'"
            " GROUP BY 1 ORDER BY count(*) DESC, activity LIMIT 1)) AS activity)"
        ", rk AS (SELECT scope, k, id, row_number() OVER (PARTITION BY scope, k ORDER BY md5('relabel-' || k || ':' || id), id) AS rn, count(*) OVER (PARTITION BY scope, k) AS c"
            " FROM sc JOIN ta USING (activity), (SELECT DISTINCT k FROM st))",
        "SELECT level, k, scope, " + _altered() + " FROM sc, st",
        "SELECT level, k, scope, " + _altered(activity="CASE WHEN rn <= round_even(level / 100 * c, 0) THEN 'changed' ELSE activity END") + " FROM sc CROSS JOIN st LEFT JOIN rk USING (scope, k, id)",
    )),
    "rephase": ([0, 1, 4], _whole_ladder_sql(
        [0, 1, 4],
        _ONE_A + ", bo AS (SELECT level, k, case_id, least(level * 3600000000, greatest(min(s) - cut, 0)) AS lo, least(level * 3600000000, greatest(fin - max(t), 0)) AS hi"
            " FROM wa, p, st GROUP BY level, k, case_id, cut, fin)"
        f", mv AS (SELECT level, k, case_id, {_MOVED} AS d FROM bo)",
        _EACH, "SELECT level, k, scope, " + _altered(s="s + d", t="t + d") + " FROM wa JOIN mv USING (case_id)",
    )),
    "swap": ([0, 40, 90], _whole_ladder_sql(
        [0, 40, 90],
        _ONE_A + _TAG + ", sn AS (SELECT least(count(*) FILTER (tag = 'blue'), count(*) FILTER (tag = 'red')) AS n FROM y)"
        ", rk AS (SELECT k, case_id, tag, row_number() OVER (PARTITION BY tag, k ORDER BY md5(CASE WHEN tag = 'blue' THEN 'swap-a-' ELSE 'swap-b-' END || k || ':' || case_id), case_id) AS rn"
            " FROM y, (SELECT DISTINCT k FROM st))"
        ", nw AS (SELECT level, k, case_id, CASE tag WHEN 'blue' THEN 'red' ELSE 'blue' END AS new FROM rk JOIN st USING (k), sn WHERE rn <= CAST(floor(level / 100 * n) AS BIGINT))",
        _EACH, _TAGGED,
    )),
    "drift": ([0, 50, 100], _whole_ladder_sql(
        [0, 50, 100],
        _ONE_A + _TAG + ", rk AS (SELECT level, k, case_id, tag, f"
            " FROM (SELECT k, case_id, tag, f, row_number() OVER (PARTITION BY k ORDER BY md5('drift-' || k || ':' || case_id), case_id) AS rn, count(*) OVER (PARTITION BY k) AS n"
            " FROM y, (SELECT DISTINCT k FROM st)) JOIN st USING (k) WHERE rn <= round_even(level / 100 * n, 0))"
        ", ps AS (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY f, case_id) AS pos, min(tag) OVER (PARTITION BY level, k) AS early FROM rk)"
        ", qs AS (SELECT *, count(*) FILTER (tag = early) OVER (PARTITION BY level, k) AS ne FROM ps)"
        ", lt AS (SELECT level, k, tag AS later, ne + row_number() OVER (PARTITION BY level, k ORDER BY pos) AS pos FROM qs WHERE tag <> early)"
        ", nw AS (SELECT level, k, case_id, CASE WHEN pos <= ne THEN early ELSE later END AS new FROM qs LEFT JOIN lt USING (level, k, pos))",
        _EACH, _TAGGED,
    )),
    "mix": ([0, 20, 50], _whole_ladder_sql(
        [0, 20, 50],
        ", gr AS MATERIALIZED (SELECT * REPLACE ('g_' || case_id AS case_id, 'green' AS case_type) FROM e)"
            ", rd AS MATERIALIZED (SELECT * REPLACE ('r_' || case_id AS case_id, 'red' AS case_type) FROM g)"
        ", nl AS (SELECT level, CAST(round_even((0.5 + level / 100) * c, 0) AS BIGINT) AS ng, c FROM (SELECT DISTINCT level FROM st), (SELECT count(DISTINCT case_id) // 2 AS c FROM e))"
        f", kp AS MATERIALIZED ({_DRAWN_MIX.format(tag='green', log='gr', n='ng')} UNION ALL {_DRAWN_MIX.format(tag='red', log='rd', n='c - ng')})"
        f", wx AS MATERIALIZED ({_WIN.format(log='gr')} AND case_id IN {_ONG.format(log='gr')} UNION ALL {_WIN.format(log='rd')} AND case_id IN {_ONG.format(log='rd')})"
        ", mx AS MATERIALIZED (SELECT level, k, 'A' AS scope, " + _altered() + " FROM wx JOIN kp USING (case_id))",
        "SELECT st.level, mx.* EXCLUDE (level) FROM mx JOIN st ON st.k = mx.k WHERE mx.level = 0", "SELECT * FROM mx", "{k}",
    )),
}


def _whole_ladder(x, name: str):
    steps, window = LA.steps(_WHOLE[name][0], _REPLICATES), (x.cut, x.end)
    ids = W.ongoing_case_ids(x.e, x.cut)
    if name == "relabel":
        base = stored(LA.scoped(x.e, x.cut, HORIZON, "AB", ids))
        activity = target_activity(base.filter("scope = 'A'"), base.filter("scope = 'B'")).first()["activity"]
        pair = LA.relabel(base, activity, "changed", steps)
    elif name == "mix":
        pair = LA.mix(x.e, x.g, 0.5, x.e.select("case_id").distinct().count() // 2, x.cut, HORIZON, steps)
    else:
        base = stored(LA.scoped(x.e, x.cut, HORIZON, "A", ids))
        pair = LA.rephase(base, *window, steps) if name == "rephase" else (LA.swap if name == "swap" else LA.drift)(x.e, base, steps)
    return LA.rows(*(stored(y) for y in pair), steps, window, x.roles)


for _name, (_, _sql) in _WHOLE.items():
    query(f"t6_m8_{_name}", _sql)(lambda x, n=_name: _whole_ladder(x, n))


query(
    "t6_ladder_utilisation",
    (
        ", rs AS (SELECT role, count(*) AS n_resources FROM r GROUP BY 1), lv AS (SELECT unnest([0, 50]) AS level)"
        ", bz AS (SELECT role, sum(least(t, fin) - greatest(s, cut)) / 1e6 AS b FROM e JOIN r USING (resource), p"
        " WHERE t > cut AND s < fin GROUP BY 1)"
        " SELECT level, 0 AS k_sim, role, n_resources, round(coalesce(b, 0), 6) AS busy_seconds, 172800.0::DOUBLE AS window_seconds, round(coalesce(b, 0) / (n_resources * 172800.0), 6) AS utilization"
        " FROM rs LEFT JOIN bz USING (role), lv"
    ),
)(lambda x: X.ladder_utilisation([(v, 0, T.relabel_fraction(x.e, "view", "changed", v / 100)) for v in (0, 50)], x.roles, (x.cut, x.end)))

_BASELINE = {
    "ngd_n2": _grams(2).replace("FROM e", "FROM we").replace("FROM g", "FROM wg"),
    "red": _w1(*[f"SELECT (unnest([s, t]) - f) // 3600000000 AS bin FROM (SELECT s, t, min(s) OVER (PARTITION BY case_id) AS f FROM {k})" for k in ("we", "wg")]),
    "cycle_time": _w1(*[f"SELECT (max(t) - min(s)) // 3600000000 AS bin FROM {k} GROUP BY case_id" for k in ("we", "wg")]),
    "rtd": ", xa AS (" + _RT.format(log="we") + "), xb AS (" + _RT.format(log="wg") + "), na AS (SELECT count(*) AS n FROM xa), nb AS (SELECT count(*) AS n FROM xb)" + _w1(_FA, _FB),
}
query(
    "m8_metric_rows",
    f", we AS ({_WIN.format(log='e')}), wg AS ({_WIN.format(log='g')})" + _sweep(_SIX, "we", "wg").replace("x.k AS key", "replace(x.k, 'role2', 'unknown') AS key")
    + (
        ", st AS (SELECT view, distance, sum(d * coalesce(next_t - t, 0)) / 172800000000 AS v FROM l GROUP BY ALL)"
        " SELECT 0 AS level, 0 AS k_baseline, 0 AS k_sim, 'B' AS scope, family, metric, round(v, 6) AS value"
        " FROM (SELECT 'state' AS family, view || '.jaccard' AS metric, v FROM st WHERE distance = 'jaccard' UNION ALL"
        " SELECT 'state', 'cardinality', v FROM st WHERE distance = 'cardinality' AND view = 'activity'"
    )
    + "".join(f" UNION ALL SELECT 'baseline', '{k}', distance FROM (WITH {v.removeprefix(', ')})" for k, v in _BASELINE.items()) + ")",
)(lambda x: X.metric_rows(W.cases_in_window(x.e, None, x.cut, HORIZON), W.cases_in_window(x.g, None, x.cut, HORIZON), 0, 0, 0, "B", (x.cut, x.end), x.roles.filter("role <> 'role2'")))
query("j9_replicate_pairs", (
    ", a AS (SELECT activity, CAST(substr(resource, 2) AS INT) AS k, count(*) AS v FROM e GROUP BY ALL)"
    ", b AS (SELECT activity, CAST(substr(resource, 2) AS INT) AS k, count(*) AS v FROM g GROUP BY ALL)"
    " SELECT activity, k, a.v AS baseline, b.v AS simulated FROM a JOIN b USING (activity, k)"
))(
    lambda x: X.paired(*[y.groupBy("activity", F.substring("resource", 2, 9).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("value")) for y in (x.e, x.g)], "activity")
)
query("j6_stab_join", (
    ", z AS (SELECT min(s) + 43200000000 AS a, max(t) - 86400000000 AS b FROM e), q AS (SELECT t"
    " FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n, count(*) OVER () AS c FROM (SELECT DISTINCT t FROM e, z"
    " WHERE t >= a AND t <= b)) WHERE n IN (SELECT CAST(floor((c - 1) * i / 79) AS BIGINT)"
    " FROM (SELECT unnest(range(0, 80)) AS i))) SELECT q.t, id FROM q JOIN e ON e.s <= q.t AND e.t > q.t"
))(
    lambda x: L.stabbed(L._active(x.e, "id"), _cuts(x), 5).select("t", "id")
)

# Features

_CUTS = (
    ", z AS (SELECT min(s) + 43200000000 AS a, max(t) - 86400000000 AS b FROM e), q AS (SELECT t"
    " FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n, count(*) OVER () AS c FROM (SELECT DISTINCT t FROM e, z"
    " WHERE t >= a AND t <= b)) WHERE n IN (SELECT CAST(floor((c - 1) * i / 79) AS BIGINT)"
    " FROM (SELECT unnest(range(0, 80)) AS i)))"
    ", en AS (SELECT *, s - CASE WHEN id % 4 = 0 THEN 7200000000 ELSE 600000000 END AS n FROM e)"
)


def _cuts(x):
    return x.cuts


def _enabled(x):
    return x.e.withColumn("enable_time", moment(micros("start_time") - F.when(F.col("id") % 4 == 0, 2 * HOUR).otherwise(HOUR // 6)))


query("l1_environment", (
    " SELECT count(DISTINCT case_id) AS cases, count(DISTINCT resource) AS resources, count(DISTINCT activity) AS activities, false AS has_enable_time"
    " FROM e"
))(lambda x: L.environment(x.e))
_WIPQ = "SELECT q.t, count(DISTINCT case_id) AS wip FROM q LEFT JOIN e ON e.s <= q.t AND e.t > q.t GROUP BY 1"
query("l2_wip", _CUTS + _WIPQ.join([" ", ""]))(lambda x: L.wip(x.e, _cuts(x)))
query("l3_arrival_rate", _CUTS + (
    ", b AS (SELECT min(s) AS f FROM e GROUP BY case_id) SELECT q.t, round(count(f) / 24, 6) AS arrival_rate_per_hour FROM q"
    " LEFT JOIN b ON f > q.t - 86400000000 AND f <= q.t GROUP BY 1"
))(lambda x: L.arrival_rate(x.e, _cuts(x), DAY))
query("l4_availability", _CUTS + " SELECT q.t, round((10 - count(DISTINCT resource)) / 10, 6) AS resource_availability FROM q LEFT JOIN e ON e.s <= q.t AND e.t > q.t GROUP BY 1")(lambda x: L.availability(x.e, _cuts(x)))
_ACTS = (
    ", v AS (SELECT q.t, activity, count(DISTINCT case_id) FILTER (k = 'o') AS wip_ongoing, count(DISTINCT case_id) FILTER (k = 'e') AS wip_enabled, max(q.t - f) FILTER (k = 'o') AS o, max(q.t - f) FILTER (k = 'e') AS n"
    " FROM q JOIN (SELECT activity, case_id, s AS f, t AS u, 'o' AS k FROM en UNION ALL SELECT activity, case_id, n, s, 'e'"
    " FROM en) y ON y.f <= q.t AND y.u > q.t GROUP BY 1, 2), w AS (SELECT t, max(greatest(o, n)) AS m FROM v GROUP BY 1)"
    ", d AS (SELECT DISTINCT activity FROM e)"
    ", fin2 AS (SELECT q.t, d.activity, coalesce(wip_enabled, 0) AS wip_enabled, coalesce(wip_ongoing, 0) AS wip_ongoing, greatest(coalesce(0.5 * n / nullif(m, 0), 0), coalesce(0.5 + 0.5 * o / nullif(m, 0), 0)) AS state"
    " FROM q CROSS JOIN d LEFT JOIN v ON v.t = q.t AND v.activity = d.activity LEFT JOIN w ON w.t = q.t)"
)
query("l5_l6_by_activity", _CUTS + _ACTS + " SELECT t, activity, wip_enabled, wip_ongoing, round(state, 6) AS state FROM fin2")(lambda x: L.by_activity(_enabled(x), _cuts(x)))
def _targets(x):
    """Errors at the cuts: remaining and elapsed hours of the cases that are active there, mean and interval over the cases."""
    spans = case_bounds(x.e).select(F.col("first").alias("a"), F.col("last").alias("b"), "case_id")
    at = L.stabbed(spans, _cuts(x))
    each = at.select("t", F.lit("RTD").alias("metric"), ((F.col("b") - F.col("t")) / HOUR).alias("value")).unionByName(at.select("t", F.lit("cycle_time").alias("metric"), ((F.col("b") - F.col("a")) / HOUR).alias("value")))
    return error_targets(aggregate_runs(each, "t", "metric"), "t")


_NAMES = ("click", "error", "purchase", "signup", "view")
query(
    "l7_samples",
    _CUTS + _ACTS + ", c AS (" + _WIPQ + (
        "), ar AS (SELECT q.t, count(f) / 24 AS rate FROM q LEFT JOIN (SELECT min(s) AS f FROM e"
        " GROUP BY case_id) b ON f > q.t - 86400000000 AND f <= q.t GROUP BY 1)"
        ", av AS (SELECT q.t, (10 - count(DISTINCT resource)) / 10 AS free FROM q LEFT JOIN e ON e.s <= q.t AND e.t > q.t"
        " GROUP BY 1), sp AS (SELECT min(s) AS f, max(t) AS l FROM e GROUP BY case_id)"
        ", tr AS (SELECT q.t, (l - q.t) / 3600000000 AS r, (l - f) / 3600000000 AS c FROM q JOIN sp ON f <= q.t AND l > q.t)"
        ", tm AS (SELECT t, avg(r) AS rm, 1.96 * stddev_samp(r) / sqrt(count(r)) AS rc, avg(c) AS cm, 1.96 * stddev_samp(c) / sqrt(count(c)) AS cc"
        " FROM tr GROUP BY 1) SELECT c.t, wip, round(rate, 6) AS arrival_rate_per_hour, round(free, 6) AS resource_availability, "
    )
    + ", ".join(f"x.wip_enabled_{n}, x.wip_ongoing_{n}, x.statevec_{n}" for n in _NAMES)
    + ", round(rm, 6) AS err_RTD_mean, round(rc, 6) AS err_RTD_ci, round(cm, 6) AS err_cycle_mean, round(cc, 6) AS err_cycle_ci FROM c JOIN ar USING (t) JOIN av USING (t) JOIN (SELECT t, "
    + ", ".join(f"max(wip_enabled) FILTER (activity = '{n}')::DOUBLE AS wip_enabled_{n}, max(wip_ongoing) FILTER (activity = '{n}')::DOUBLE AS wip_ongoing_{n}, round(max(state) FILTER (activity = '{n}'), 6) AS statevec_{n}" for n in _NAMES)
    + " FROM fin2 GROUP BY 1) x USING (t) LEFT JOIN tm USING (t)",
)(lambda x: L.samples(_enabled(x), _cuts(x), DAY, _targets(x)))

# Models: the target is the mean remaining time of active cases at the cut, in hours; even positions train.


def _sampled(x):
    rows = L.samples(x.e, _cuts(x), DAY)
    spans = case_bounds(x.e).select(F.col("first").alias("a"), F.col("last").alias("b"), "case_id")
    err = L.stabbed(spans, _cuts(x)).groupBy("t").agg(F.avg((F.col("b") - F.col("t")) / HOUR).alias("err"))
    rows = stored(rows.join(err, "t", "left"))
    placed = W.numbered(rows.select("t"), "t")
    rows = stored(rows.join(placed, "t"))  # a row a cut
    return rows.filter("n % 2 = 0").drop("n"), rows.filter("n % 2 = 1").drop("n")


_SAMPLE = _CUTS + ", c AS (" + _WIPQ + (
    "), b AS (SELECT case_id, min(s) AS f, max(t) AS l FROM e GROUP BY 1)"
    ", er AS (SELECT q.t, avg((l - q.t) / 3600000000) AS err FROM q JOIN b ON f <= q.t AND l > q.t GROUP BY 1)"
    ", sm AS (SELECT c.t, wip, err, row_number() OVER (ORDER BY c.t) - 1 AS n FROM c LEFT JOIN er USING (t)), tr AS (SELECT *"
    " FROM sm WHERE n % 2 = 0), te AS (SELECT * FROM sm WHERE n % 2 = 1)"
    ", kn AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS k FROM tr WHERE err IS NOT NULL)"
    ", ed AS (SELECT quantile_cont(wip, 0.0) - 1e-9 AS e0, quantile_cont(wip, 1.0 / 3) AS e1, quantile_cont(wip, 2.0 / 3) AS e2, quantile_cont(wip, 1.0) AS e3"
    " FROM tr WHERE err IS NOT NULL)"
    ", wb AS (SELECT err, CASE WHEN wip > e0 AND wip <= e1 THEN 0 WHEN wip > e1 AND wip <= e2 THEN 1 WHEN wip > e2 AND wip <= e3 + 1e-9 THEN 2 END AS group_id"
    " FROM tr, ed WHERE err IS NOT NULL)"
)
_AGG = "round(avg(err), 6) AS mean, round(CASE WHEN count(err) = 1 THEN 0 ELSE 1.96 * stddev_samp(err) END, 6) AS ci, count(err) AS count"
query("l8_baseline", _SAMPLE + f" SELECT {_AGG}, round(quantile_cont(err, 0.05), 6) AS q05, round(quantile_cont(err, 0.5), 6) AS q50 FROM tr")(lambda x: MO.baseline(_sampled(x)[0], "err").select("mean", "ci", "count", F.col("quantiles")[0].alias("q05"), F.col("quantiles")[2].alias("q50")))
query("l9_random_groups", _SAMPLE + f" SELECT k % 3 AS group_id, {_AGG} FROM kn GROUP BY 1")(lambda x: MO.random_groups(_sampled(x)[0], "err"))
query("l10_wip_groups", _SAMPLE + f" SELECT group_id, {_AGG} FROM wb WHERE group_id IS NOT NULL GROUP BY 1")(lambda x: (lambda tr: MO.wip_groups(tr, "err", MO.wip_edges(tr, "err")))(_sampled(x)[0]))
query("l13_assign_wip", _SAMPLE + " SELECT te.t, wip, greatest(0, least(2, (wip >= e0)::INT + (wip >= e1)::INT + (wip >= e2)::INT + (wip >= e3)::INT - 1)) AS group_id FROM te, ed")(lambda x: (lambda tr, te: te.select("t", "wip", MO.assign_wip(F.col("wip"), MO.wip_edges(tr, "err")).alias("group_id")))(*_sampled(x)))
_EVAL = (
    ", g1 AS (SELECT avg(err) AS m, 1.96 * stddev_samp(err) AS ci FROM tr)"
    ", g2 AS (SELECT k % 3 AS g, avg(err) AS m, CASE WHEN count(err) = 1 THEN 0 ELSE 1.96 * stddev_samp(err) END AS ci"
    " FROM kn GROUP BY 1), g3 AS (SELECT group_id AS g, avg(err) AS m, CASE WHEN count(err) = 1 THEN 0 ELSE 1.96 * stddev_samp(err) END AS ci"
    " FROM wb GROUP BY 1), tp AS (SELECT te.*, row_number() OVER (ORDER BY te.t) - 1 AS k, greatest(0, least(2, (wip >= e0)::INT + (wip >= e1)::INT + (wip >= e2)::INT + (wip >= e3)::INT - 1)) AS w"
    " FROM te, ed), ev AS (SELECT tp.t, err, abs(err - g1.m) <= g1.ci AS baseline_in_ci, g1.ci AS baseline_ci, abs(err - g2.m) <= g2.ci AS random_groups_in_ci, g2.ci AS random_groups_ci, abs(err - g3.m) <= g3.ci AS wip_decile_in_ci, g3.ci AS wip_decile_ci"
    " FROM tp CROSS JOIN g1 LEFT JOIN g2 ON g2.g = tp.k % 3 LEFT JOIN g3 ON g3.g = tp.w)"
)
query("l14_apply_models", _SAMPLE + _EVAL + " SELECT t, round(err, 6) AS err, baseline_in_ci, random_groups_in_ci, wip_decile_in_ci FROM ev")(lambda x: MO.simple_methods(*_sampled(x), "err").select("t", "err", "baseline_in_ci", "random_groups_in_ci", "wip_decile_in_ci"))
_SUMM = (
    ", un AS (SELECT 'baseline' AS method_key, baseline_in_ci AS h, baseline_ci AS ci, err FROM ev UNION ALL"
    " SELECT 'random_groups', random_groups_in_ci, random_groups_ci, err FROM ev UNION ALL"
    " SELECT 'wip_deciles', wip_decile_in_ci, wip_decile_ci, err FROM ev)"
)
query("a15_a17_summary", _SAMPLE + _EVAL + _SUMM + (
    " SELECT method_key, count(h) AS n_points, round(avg(h::INT), 6) AS coverage, round(avg(ci) FILTER (h IS NOT NULL), 6) AS avg_ci_width, round(avg(abs(err)) FILTER (h IS NOT NULL), 6) AS avg_abs_error"
    " FROM un GROUP BY 1"
))(lambda x: MO.summarised(MO.simple_methods(*_sampled(x), "err"), "err"))
query("a16_train_coverage", _SAMPLE + _EVAL.replace("FROM te, ed)", "FROM tr te, ed)") + _SUMM + (
    " SELECT method_key, count(h) AS n_points, round(avg(h::INT), 6) AS coverage, round(avg(ci) FILTER (h IS NOT NULL), 6) AS avg_ci_width, round(avg(abs(err)), 6) AS avg_abs_error"
    " FROM un GROUP BY 1"
))(
    lambda x: (lambda tr, te: MO.summarised(MO.simple_methods(tr, tr, "err"), "err", with_width=True))(*_sampled(x))
)
query("a18_compare_methods", _SAMPLE + _EVAL + _SUMM + " SELECT method_key, row_number() OVER (ORDER BY avg(h::INT) DESC, avg(ci), method_key) AS place FROM un WHERE h IS NOT NULL GROUP BY 1")(lambda x: MO.compared(MO.summarised(MO.simple_methods(*_sampled(x), "err"), "err")).select("method_key", "place"))
# Clusterings: centres by farthest samples, then rounds of nearest centre and mean, repeated by recursion.

_WIDE = [f"{k}_{n}" for k in ("wip_enabled", "wip_ongoing", "statevec") for n in _NAMES]
_PIVOT = ", ".join(f"max({k}) FILTER (activity = '{n}') AS {k}_{n}" for k in ("wip_enabled", "wip_ongoing") for n in _NAMES) + ", " + ", ".join(f"max(state) FILTER (activity = '{n}') AS statevec_{n}" for n in _NAMES)
_FEATURES = (
    _ACTS.replace(" UNION ALL SELECT activity, case_id, n, s, 'e' FROM en", "")  # the sampled log has no enable times
    + ", ar AS (SELECT q.t, count(f) / 24 AS arrival_rate_per_hour FROM q LEFT JOIN (SELECT min(s) AS f FROM e GROUP BY case_id) b ON f > q.t - 86400000000 AND f <= q.t GROUP BY 1)"
    ", av AS (SELECT q.t, (10 - count(DISTINCT resource)) / 10 AS resource_availability FROM q LEFT JOIN e ON e.s <= q.t AND e.t > q.t GROUP BY 1)"
    f", fx AS MATERIALIZED (SELECT sm.t, sm.n, sm.err, wip, arrival_rate_per_hour, resource_availability, {', '.join(_WIDE)} FROM sm"
        f" JOIN ar USING (t) JOIN av USING (t) JOIN (SELECT t, {_PIVOT} FROM fin2 GROUP BY 1) USING (t))"
)
_SETS = MO.feature_sets(_WIDE)


def _kmeans_sql(stem: str, features: list[str]) -> str:
    """Tables <stem>_c (the centres of each round), <stem>_g (group, mean, interval, count) and <stem>_t (t, group) of the test samples."""
    x = "[" + ", ".join(f"round({c} * 1e6)::BIGINT::DOUBLE" for c in features) + "]"
    far = lambda c: f"list_sum(list_transform(x, lambda v, i: (v - {c}[i]) * (v - {c}[i])))"
    at = f"list_position(list_transform(c, lambda u: {far('u')}), list_min(list_transform(c, lambda u: {far('u')})))"
    mean = "[" + ", ".join(f"sum(x[{i + 1}]) / count(*)" for i in range(len(features))) + "]"
    return f""", {stem}_x AS MATERIALIZED (SELECT t, n, err, {x} AS x FROM fx), {stem}_r AS MATERIALIZED (SELECT * FROM {stem}_x WHERE n % 2 = 0 AND err IS NOT NULL),
{stem}_1 AS (SELECT arg_min(x, t) AS a FROM {stem}_r), {stem}_2 AS (SELECT a, arg_max(x, {{'d': {far('a')}, 't': -t}}) AS b FROM {stem}_r, {stem}_1 GROUP BY a),
{stem}_3 AS (SELECT a, b, arg_max(x, {{'d': least({far('a')}, {far('b')}), 't': -t}}) AS c FROM {stem}_r, {stem}_2 GROUP BY a, b),
{stem}_c AS (SELECT 0 AS it, [a, b, c] AS c FROM {stem}_3 UNION ALL
  SELECT it + 1, list(coalesce(m, o) ORDER BY g) FROM (SELECT it, g, c[g] AS o FROM (SELECT it, c, unnest([1, 2, 3]) AS g FROM {stem}_c WHERE it < 30))
    LEFT JOIN (SELECT g, {mean} AS m FROM (SELECT {at} AS g, x FROM {stem}_r, {stem}_c) GROUP BY g) USING (g) GROUP BY it),
{stem}_f AS MATERIALIZED (SELECT c FROM {stem}_c WHERE it = 30),
{stem}_g AS MATERIALIZED (SELECT g, avg(err) AS m, CASE WHEN count(err) = 1 THEN 0 ELSE 1.96 * stddev_samp(err) END AS ci, count(err) AS count FROM (SELECT {at} - 1 AS g, err FROM {stem}_r, {stem}_f) GROUP BY 1),
{stem}_t AS MATERIALIZED (SELECT t, err, {at} - 1 AS g FROM {stem}_x, {stem}_f WHERE n % 2 = 1)"""


_CLUSTERS = _SAMPLE + _FEATURES + "".join(_kmeans_sql(*x) for x in _SETS.items())


def _clustered(x):
    train, test = _sampled(x)
    return train, test, {stem: (features, MO.kmeans(train, features, "err")) for stem, features in MO.feature_sets(train.columns).items()}


@query("l11_kmeans_groups", _CLUSTERS + " " + " UNION ALL ".join(f"SELECT '{k}' AS method, g::INT AS group_id, round(m, 6) AS mean, round(ci, 6) AS ci, count FROM {k}_g" for k in _SETS))
def _(x):
    out = None
    for stem, (_, (_, groups)) in _clustered(x)[2].items():
        part = groups.select(F.lit(stem).alias("method"), "group_id", "mean", "ci", "count")
        out = part if out is None else out.unionByName(part)
    return out


@query("j7_nearest_centroid", _CLUSTERS + " SELECT t, " + ", ".join(f"{k}_t.g::INT AS {k}" for k in _SETS) + " FROM " + " JOIN ".join(f"{k}_t" + (" USING (t)" if i else "") for i, k in enumerate(_SETS)))
def _(x):
    _, test, found = _clustered(x)
    for stem, (features, (centres, _)) in found.items():
        test = MO.assigned(test, centres, features, stem)
    return test.select("t", *found)


_ALL = ", un AS (" + _SUMM.split("un AS (", 1)[1].rstrip(")") + "".join(f" UNION ALL SELECT '{k}', abs(z.err - y.m) <= y.ci, y.ci, z.err FROM {k}_t z LEFT JOIN {k}_g y USING (g)" for k in _SETS) + ")"
query("l11_l12_all_methods", _CLUSTERS + _EVAL + _ALL + (
    " SELECT method_key, count(h) AS n_points, round(avg(h::INT), 6) AS coverage, round(avg(ci) FILTER (h IS NOT NULL), 6) AS avg_ci_width, round(avg(abs(err)) FILTER (h IS NOT NULL), 6) AS avg_abs_error"
    " FROM un GROUP BY 1"
))(
    lambda x: MO.summarised(MO.all_methods(*_sampled(x), "err"), "err")
)
for _name in ("l11_kmeans_groups", "j7_nearest_centroid", "l11_l12_all_methods"):
    SQL[_name] = SQL[_name].replace("WITH e AS", "WITH RECURSIVE e AS", 1)
query("j1_samples_with_evaluation", _SAMPLE + _EVAL + (
    " SELECT strftime(make_timestamp(te.t), '%Y-%m-%dT%H:%M:%SZ') AS cut_time_iso, wip, baseline_in_ci FROM te"
    " JOIN ev ON strftime(make_timestamp(te.t), '%Y-%m-%dT%H:%M:%SZ') = strftime(make_timestamp(ev.t), '%Y-%m-%dT%H:%M:%SZ')"
))(
    lambda x: (lambda tr, te: MO.joined_samples(te.select(F.date_format(moment(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("cut_time_iso"), "wip"), MO.simple_methods(tr, te, "err").select(F.date_format(moment(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("cut_time_iso"), "baseline_in_ci")))(*_sampled(x))
)

# Rankings: durations of each activity by level (weeks of the log) and resource


def _results(x):
    level = (F.dayofmonth("start_time") - 1) / 7
    return x.e.groupBy(F.lit("A").alias("scope"), F.col("case_type").alias("family"), F.col("activity").alias("metric"), F.floor(level).cast("int").alias("level"), "resource").agg(F.avg((micros("end_time") - micros("start_time")) / 1e9).alias("value"))


_RES = (
    ", rs AS (SELECT 'A' AS scope, case_type AS family, activity AS metric, CAST(floor((dayofmonth(make_timestamp(s)) - 1) / 7) AS INT) AS level, resource, avg((t - s) / 1e9) AS value"
    " FROM e GROUP BY ALL), lm AS (SELECT scope, family, metric, level, avg(value) AS m FROM rs GROUP BY ALL)"
    ", rk AS (SELECT *, rank() OVER (PARTITION BY scope, family, metric ORDER BY level) AS x, rank() OVER (PARTITION BY scope, family, metric ORDER BY m) AS y"
    " FROM lm)"
)
query("r1_concordance", _RES + (
    " SELECT a.scope, a.family, a.metric, round(avg(CASE WHEN b.value > a.value THEN 1 WHEN b.value = a.value THEN 0.5 ELSE 0 END), 6) AS c_index"
    " FROM rs a JOIN rs b ON a.scope = b.scope AND a.family = b.family AND a.metric = b.metric AND a.level < b.level"
    " GROUP BY ALL"
))(lambda x: R.concordance(_results(x), R.GROUP))
query("r2_spearman", _RES + " SELECT scope, family, metric, round(corr(x, y), 6) AS spearman FROM rk GROUP BY ALL")(lambda x: R.spearman(R.level_means(_results(x), R.GROUP), R.GROUP))
_TAU = (
    "SELECT a.scope, a.family, a.metric, round(sum(sign(b.m - a.m)) / sqrt(count(*) * count(*) FILTER (b.m <> a.m)), 6) AS kendall"
    " FROM lm a JOIN lm b ON a.scope = b.scope AND a.family = b.family AND a.metric = b.metric AND a.level < b.level"
    " GROUP BY ALL"
)
query("r3_kendall", _RES + " " + _TAU)(lambda x: R.kendall(R.level_means(_results(x), R.GROUP), R.GROUP))
_DRAWS = """, rb AS (SELECT scope, family, metric, level, value, row_number() OVER (PARTITION BY scope, family, metric, level ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY scope, family, metric, level) AS n FROM rs),
tr AS (SELECT *, unnest(range(1, {n} + 1)) AS it FROM rb),
pk AS (SELECT scope, family, metric, level, it, CAST(floor((('0x' || substr(md5('bootstrap:' || concat_ws(':', scope, family, metric, level, k, it)), 1, 8))::BIGINT / 4294967296.0) * n) AS INT) AS k FROM tr),
dr AS MATERIALIZED (SELECT pk.scope, pk.family, pk.metric, pk.level, it, value FROM pk JOIN rb ON pk.scope = rb.scope AND pk.family = rb.family AND pk.metric = rb.metric AND pk.level = rb.level AND pk.k = rb.k),
bc AS (SELECT a.scope, a.family, a.metric, a.it, avg(CASE WHEN b.value > a.value THEN 1 WHEN b.value = a.value THEN 0.5 ELSE 0 END) AS c FROM dr a JOIN dr b ON a.scope = b.scope AND a.family = b.family AND a.metric = b.metric AND a.it = b.it AND a.level < b.level GROUP BY ALL),
bm AS MATERIALIZED (SELECT scope, family, metric, it, level, avg(value) AS m FROM dr GROUP BY ALL),
br AS (SELECT *, rank() OVER (PARTITION BY scope, family, metric, it ORDER BY level) AS x, rank() OVER (PARTITION BY scope, family, metric, it ORDER BY m) AS y FROM bm),
bs AS (SELECT scope, family, metric, it, corr(x, y) AS sp FROM br GROUP BY ALL),
bk AS (SELECT a.scope, a.family, a.metric, a.it, sum(sign(b.m - a.m)) / sqrt(count(*) * count(*) FILTER (b.m <> a.m)) AS ke FROM bm a JOIN bm b ON a.scope = b.scope AND a.family = b.family AND a.metric = b.metric AND a.it = b.it AND a.level < b.level GROUP BY ALL),
bt AS (SELECT * FROM bc JOIN bs USING (scope, family, metric, it) JOIN bk USING (scope, family, metric, it))"""
_CI = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {name}_ci_{side}" for name, c in (("c_index", "c"), ("spearman", "sp"), ("kendall", "ke")) for side, q in (("low", 0.025), ("high", 0.975)))
query("r4_bootstrap", _RES + _DRAWS.format(n=1000) + f" SELECT scope, family, metric, {_CI} FROM bt GROUP BY ALL")(lambda x: R.bootstrap(_results(x), R.GROUP))
query("r5_rankings", _RES + (
    ", c AS (SELECT a.family, a.metric, avg(CASE WHEN b.value > a.value THEN 1 WHEN b.value = a.value THEN 0.5 ELSE 0 END) AS c"
    " FROM rs a JOIN rs b ON a.family = b.family AND a.metric = b.metric AND a.level < b.level GROUP BY ALL), k AS ("
) + _TAU + (
    "), n AS (SELECT family, metric, count(*) AS n_levels, min(n) AS mn FROM (SELECT family, metric, level, count(*) AS n"
    " FROM rs GROUP BY ALL) GROUP BY ALL)"
    " SELECT 'A' AS scope, family, metric, n_levels, mn AS min_replicates_per_level, round(c, 6) AS c_index, (SELECT round(corr(x, y), 6)"
    " FROM rk WHERE rk.family = n.family AND rk.metric = n.metric) AS spearman, kendall FROM n JOIN c USING (family, metric)"
    " JOIN k USING (family, metric)"
))(lambda x: R.rankings(_results(x), 0))
query("j8_replicate_pairs", _RES + " SELECT family, metric, a.level AS low, b.level AS high, count(*) AS pairs FROM rs a JOIN rs b USING (family, metric) WHERE a.level < b.level GROUP BY ALL")(
    lambda x: (lambda n: n.join(n.select("family", "metric", F.col("level").alias("low"), F.col("n").alias("m")), ["family", "metric"]).filter("low < level").select("family", "metric", "low", F.col("level").alias("high"), (F.col("n") * F.col("m")).alias("pairs")))(_results(x).groupBy("family", "metric", "level").agg(F.count(F.lit(1)).alias("n")))
)
