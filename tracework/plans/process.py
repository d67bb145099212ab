"""Queries: process state, scalar functions, sources and sinks, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.functions import scalar as X
from tracework.functions.scalar import micros, moment
from tracework.operators import snapshot as P
from tracework.operators import sweep as M
from tracework.operators import windows as W
from tracework.plans.base import BASE, Logs, folder, micros_out, rounded, stored
from tracework.sources import files as S

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = lambda spark, d: rounded(fn(Logs(spark, d)))
        if sql:
            SQL[name] = BASE + sql
        return fn

    return add


def _folder(x, name: str) -> str:
    return folder(x.spark, name)


# A process model whose tasks are the log's activities: view, then a gateway to click or error, then purchase, then the end.
_NODES = [("n0", "startEvent", "begin"), ("t1", "task", "view"), ("g1", "exclusiveGateway", "split"), ("t2", "task", "click"), ("t3", "task", "error"), ("g2", "exclusiveGateway", "join"), ("t4", "task", "purchase"), ("n9", "endEvent", "end")]
_FLOWS = [("f0", "n0", "t1"), ("f1", "t1", "g1"), ("f2", "g1", "t2"), ("f3", "g1", "t3"), ("f4", "t2", "g2"), ("f5", "t3", "g2"), ("f6", "g2", "t4"), ("f7", "t4", "n9")]
_AFTER = {"view": ["f1"], "click": ["f4"], "error": ["f5"], "purchase": ["f7"], "signup": ["f0"]}
_INDEX = [([f"{a}+COMPLETE"], m) for a, m in _AFTER.items()] + [([f"{a}+START"], [t]) for a, t in (("view", "t1"), ("click", "t2"), ("error", "t3"), ("purchase", "t4"))] + [(["view+COMPLETE", "click+START"], ["t2", "t4"])]
#: Two grams with two markings each: neither counts, whatever their length.
_INDEX += [(["<start>", "view+START"], [m]) for m in ("t1", "f0")] + [(["click+COMPLETE", "view+START"], m) for m in (["t1"], ["t1", "f4"])]


def _model(x):
    return x.spark.createDataFrame(_NODES, "node_id string, kind string, name string"), x.spark.createDataFrame(_FLOWS, "flow_id string, source string, target string"), x.spark.createDataFrame(_INDEX, "gram array<string>, marking array<string>")


def _values(rows, names) -> str:
    lit = lambda v: "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, list) else f"'{v}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


_SNAP = ", sn AS (SELECT id, case_id, activity, resource, s, CASE WHEN t <= cut THEN t END AS t, case_type FROM e, p WHERE s <= cut AND case_id IN (SELECT case_id FROM e, p WHERE s > cut OR t > cut))"
_CONC = (
    ", fl AS (SELECT id, case_id, activity, s, coalesce(t, (SELECT max(t) FROM {log}) + 3600000000) AS t FROM {log})"
    ", cp AS (SELECT x.activity AS a, y.activity AS b FROM fl x"
    " JOIN fl y ON x.case_id = y.case_id AND x.id <> y.id AND x.activity <> y.activity"
    " GROUP BY 1, 2 HAVING avg(CASE WHEN x.s < y.t AND y.s < x.t THEN 1.0 ELSE 0 END) >= {th})"
    ", en AS (SELECT x.id, coalesce((SELECT max(y.t) FROM fl y"
    " WHERE y.case_id = x.case_id AND y.id <> x.id AND y.t <= x.s AND NOT EXISTS (SELECT 1 FROM cp"
    " WHERE cp.a = x.activity AND cp.b = y.activity)), min(x.s) OVER (PARTITION BY x.case_id)) AS enable_time FROM fl x)"
)


def _prepared(x):
    return W.prepare_snapshot(x.e, x.cut)


query("p1_concurrent_pairs", _CONC.format(log="e", th=0.02) + " SELECT a, b FROM cp")(lambda x: P.concurrent_pairs(x.e, 0.02))
query("p1_enabled_times", _CONC.format(log="e", th=0.5) + " SELECT id, enable_time FROM en")(lambda x: micros_out(P.enabled_times(x.e).select("id", "enable_time")))
query("p2_row_attributes", " SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + 1 AS n, case_type FROM e")(
    lambda x: (lambda d: d.select("id", F.size("m").alias("n"), F.element_at("m", "case_type").alias("case_type")))(x.e.withColumn("extra", F.when(F.col("id") % 3 == 0, F.col("id"))).withColumn("m", P.row_attributes(["case_type", "extra"])))
)
query("p3_case_attributes", (
    ", q AS (SELECT *, CASE WHEN id % 3 = 0 THEN id END AS season FROM e)"
    " SELECT case_id, arg_min(season, {'s': s, 'id': id}) FILTER (season IS NOT NULL) AS season FROM q GROUP BY 1"
))(lambda x: P.case_attributes(x.e.withColumn("season", F.when(F.col("id") % 3 == 0, F.col("id"))), ["season"]))
query("p4_latest_attributes", (
    ", q AS (SELECT *, CASE WHEN id % 3 = 0 THEN id END AS season, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, id DESC) AS rn"
    " FROM e) SELECT case_id, season FROM q WHERE rn = 1"
))(lambda x: P.latest_attributes(x.e.withColumn("season", F.when(F.col("id") % 3 == 0, F.col("id"))), ["season"]))
query("p4_global_attributes", " SELECT id AS season, activity FROM e ORDER BY s DESC, id DESC LIMIT 1")(lambda x: P.global_attributes(x.e.withColumn("season", F.col("id")), ["season", "activity"]))
query(
    "p5_ongoing_activities",
    _SNAP + _CONC.format(log="sn", th=0.5) + ", nd AS (SELECT * FROM " + _values(_NODES, "node_id, kind, name") + (
        ") SELECT case_id, node_id, activity AS label, s AS start_time, resource, CASE WHEN node_id IS NOT NULL THEN enable_time END AS enabled_time"
        " FROM sn LEFT JOIN nd ON nd.name = activity AND nd.kind = 'task' JOIN en USING (id) WHERE t IS NULL"
    ),
)(lambda x: micros_out(P.ongoing_activities(P.enabled_times(_prepared(x)), _model(x)[0]).drop("event_attributes")))
_TRACE = (
    ", tr AS (SELECT case_id, list(l ORDER BY tm, s, id, k) AS trace"
    " FROM (SELECT case_id, s AS tm, s, id, 0 AS k, activity || '+START' AS l FROM {log} UNION ALL"
    " SELECT case_id, t, s, id, 1, activity || '+COMPLETE' FROM {log} WHERE t IS NOT NULL) GROUP BY 1)"
)
query("p6_traces", _TRACE.format(log="e") + " SELECT case_id, '<start> ' || array_to_string(trace, ' ') AS trace FROM tr")(lambda x: P.traces(x.e).select("case_id", F.array_join("trace", " ").alias("trace")))
_MARK = ", ix AS (SELECT gram, min(marking) AS marking FROM " + _values(_INDEX, "gram, marking") + (
    " GROUP BY 1 HAVING min(marking) = max(marking)), mk AS (SELECT case_id, coalesce((SELECT arg_max(marking, len(gram))"
    " FROM ix WHERE list_slice(trace, -len(gram), -1) = gram), CAST([] AS VARCHAR[])) AS marking FROM tr)"
)
query("p7_markings", _SNAP + _TRACE.format(log="sn") + _MARK + " SELECT case_id, array_to_string(marking, ' ') AS marking FROM mk")(lambda x: P.markings(P.traces(_prepared(x)), _model(x)[2]).select("case_id", F.array_join("marking", " ").alias("marking")))
_STATE = ", nd AS (SELECT * FROM " + _values(_NODES, "node_id, kind, name") + "), fw AS (SELECT * FROM " + _values(_FLOWS, "flow_id, source, target") + (
    "), me AS (SELECT case_id, unnest(marking) AS el FROM mk), lv AS (SELECT DISTINCT case_id, node_id AS el FROM sn"
    " JOIN nd ON nd.name = activity AND kind = 'task' WHERE t IS NULL), st AS (SELECT case_id, 'flow' AS kind, el AS element"
    " FROM me WHERE el IN (SELECT flow_id FROM fw) UNION SELECT case_id, 'activity', el FROM me SEMI"
    " JOIN lv USING (case_id, el) WHERE el IN (SELECT node_id FROM nd) UNION SELECT case_id, 'flow', flow_id FROM (SELECT *"
    " FROM me ANTI JOIN lv USING (case_id, el)) JOIN fw ON target = el JOIN nd ON nd.node_id = el AND nd.kind = 'task')"
)
_FULL = _SNAP + _TRACE.format(log="sn") + _MARK + _STATE


def _state(x):
    log = stored(P.enabled_times(_prepared(x)))
    nodes, flows, index = _model(x)
    return log, nodes, flows, stored(P.repaired(P.markings(P.traces(log), index), P.ongoing_activities(log, nodes), nodes, flows))


query("p8_repaired_state", _FULL + " SELECT case_id, kind, element FROM st")(lambda x: _state(x)[3])
_SINCE = ", fi AS (SELECT case_id, min(s) AS f, max(t) AS l FROM sn GROUP BY 1), dn AS (SELECT case_id, activity, max(t) AS t FROM sn WHERE t IS NOT NULL GROUP BY 1, 2)"
_TG = ", tg AS (SELECT DISTINCT case_id, node_id, name FROM st JOIN fw ON flow_id = element JOIN nd ON node_id = target WHERE st.kind = 'flow' AND nd.kind IN ({kinds}))"
_EN = (
    " SELECT tg.case_id, node_id, coalesce((SELECT max(dn.t) FROM dn WHERE dn.case_id = tg.case_id AND NOT EXISTS (SELECT 1"
    " FROM cp WHERE a = tg.name AND b = dn.activity)), f) AS enabled FROM tg JOIN fi USING (case_id)"
)
query("p9_enabled_activities", _FULL + _CONC.format(log="sn", th=0.5) + _SINCE + _TG.format(kinds="'task'") + _EN)(lambda x: (lambda s: P.enabled_activities(s[0], s[3], s[1], s[2], P.concurrent_pairs(P.filled_ends(s[0]))))(_state(x)))
query("p13_enabled_events", _FULL + _CONC.format(log="sn", th=0.5) + _SINCE + _TG.format(kinds="'startEvent', 'endEvent'") + _EN)(lambda x: (lambda s: P.enabled_events(s[0], s[3], s[1], s[2], P.concurrent_pairs(P.filled_ends(s[0]))))(_state(x)))
_UP = ", up AS (SELECT * FROM (VALUES ('g1', 't1'), ('g2', 't2'), ('g2', 't3')) AS v(node_id, task))"


@query("p10_upstream_tasks", ", a AS (SELECT DISTINCT activity FROM e) SELECT 'g_' || b.activity AS node_id, 't_' || a.activity AS task FROM a, a AS b WHERE a.activity <= b.activity")
def _(x):
    """A model made from the log: each activity's task feeds its gateway, and each gateway the next one by name, the last the first task."""
    acts = x.e.select("activity").distinct().withColumn("next", F.lead("activity").over(Window.orderBy("activity")))  # a row an activity
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    nodes = acts.select(name("t_", "activity").alias("node_id"), F.lit("task").alias("kind")).unionByName(acts.select(name("g_", "activity").alias("node_id"), F.lit("exclusiveGateway").alias("kind")))
    flows = acts.select(name("t_", "activity").alias("source"), name("g_", "activity").alias("target")).unionByName(acts.filter("next IS NOT NULL").select(name("g_", "activity").alias("source"), name("g_", "next").alias("target")))
    return P.upstream_tasks(nodes, flows)


query(
    "p11_enabled_gateways",
    _FULL + _SINCE + _UP + _TG.format(kinds="'exclusiveGateway'") + (
        " SELECT case_id, node_id, coalesce((SELECT max(dn.t) FROM dn JOIN nd ON nd.name = dn.activity"
        " JOIN up ON up.task = nd.node_id WHERE dn.case_id = tg.case_id AND up.node_id = tg.node_id), l, f) AS enabled FROM tg"
        " JOIN fi USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM st JOIN up ON up.task = st.element"
        " WHERE st.kind = 'activity' AND st.case_id = tg.case_id AND up.node_id = tg.node_id)"
    ),
)(lambda x: (lambda s: P.enabled_gateways(s[0], s[3], s[1], s[2], P.upstream_tasks(s[1], s[2])))(_state(x)))
query("p12_unfinished_cases", _FULL + (
    " SELECT DISTINCT case_id FROM sn WHERE case_id NOT IN (SELECT case_id FROM st JOIN fw ON flow_id = element"
    " JOIN nd ON node_id = target WHERE st.kind = 'flow' AND nd.kind = 'endEvent')"
))(
    lambda x: (lambda s: P.without_finished(s[0].select("case_id").distinct(), P.enabled_events(s[0], s[3], s[1], s[2], P.concurrent_pairs(P.filled_ends(s[0]))), s[1]))(_state(x))  # ends that are enabled, be they events
)


def _snapshot(x):
    nodes, flows, index = _model(x)
    return P.snapshot(_prepared(x), nodes, flows, index, ["case_type"], ["activity"])


_P14 = _FULL + _UP + (
    ", fl AS (SELECT case_id, string_agg(DISTINCT element, ' ' ORDER BY element) AS flows FROM st WHERE kind = 'flow'"
        " GROUP BY 1), og AS (SELECT case_id, count(*) AS n FROM sn WHERE t IS NULL GROUP BY 1)"
        ", tg AS (SELECT DISTINCT case_id, node_id, nd.kind FROM st JOIN fw ON flow_id = element JOIN nd ON node_id = target"
        " WHERE st.kind = 'flow'),"
    " ct AS (SELECT case_id, count(*) FILTER (kind = 'task') AS a, count(*) FILTER (kind IN ('startEvent', 'endEvent')) AS ev, count(*) FILTER (kind = 'exclusiveGateway' AND NOT EXISTS (SELECT 1"
        " FROM st JOIN up ON up.task = st.element"
        " WHERE st.kind = 'activity' AND st.case_id = tg.case_id AND up.node_id = tg.node_id)) AS g FROM tg GROUP BY 1),"
    " ps AS (SELECT c.case_id, coalesce(flows, '') AS flows, coalesce(og.n, 0) AS ongoing, coalesce(a, 0) AS activities, coalesce(g, 0) AS gateways, coalesce(ev, 0) AS events"
        " FROM (SELECT DISTINCT case_id FROM sn) c LEFT JOIN fl USING (case_id) LEFT JOIN og USING (case_id) LEFT"
        " JOIN ct USING (case_id))"
)
query("p14_snapshot", _P14 + " SELECT * FROM ps")(lambda x: _snapshot(x).select("case_id", F.array_join("flows", " ").alias("flows"), F.size("ongoing_activities").alias("ongoing"), F.size("enabled_activities").alias("activities"), F.size("enabled_gateways").alias("gateways"), F.size("enabled_events").alias("events")))
query("p15_node_kinds", ", nd AS (SELECT * FROM " + _values(_NODES, "node_id, kind, name") + ") SELECT kind, count(*) AS n FROM e JOIN nd ON nd.name = activity GROUP BY 1")(lambda x: x.e.join(_model(x)[0].withColumnRenamed("name", "activity"), "activity").groupBy("kind").agg(F.count(F.lit(1)).alias("n")))

# Scalar functions, over times and names of the log as text

_ISO = "strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%S.%f')"


@query("x1_fractional_seconds", " SELECT id, CASE WHEN id % 3 = 0 THEN strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%S') || '.000+00:00' WHEN id % 3 = 1 THEN " + _ISO + " ELSE strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%S') || '.000' END AS x FROM e")
def _(x):
    t = F.when(F.col("id") % 3 == 0, F.date_format("start_time", "yyyy-MM-dd HH:mm:ss'+00:00'")).when(F.col("id") % 3 == 1, F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return x.e.select("id", X.ensure_fractional_seconds(t).alias("x"))


@query("x2_parse_datetime", " SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN s - s % 1000000 ELSE s END AS x FROM e")
def _(x):
    t = F.when(F.col("id") % 5 == 0, F.lit("")).when(F.col("id") % 5 == 1, F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return x.e.select("id", F.unix_micros(X.parse_datetime(t)).alias("x"))


query("x3_format_ms", f" SELECT id, substr({_ISO}, 1, 23) AS x FROM e")(lambda x: x.e.select("id", X.format_ms(F.col("start_time")).alias("x")))
query("x5_safe_name", " SELECT id, CASE id % 4 WHEN 0 THEN 'act' WHEN 1 THEN activity || '_' || id % 3 WHEN 2 THEN activity || '_x' ELSE activity END AS x FROM e")(
    lambda x: x.e.select("id", X.safe_name(F.when(F.col("id") % 4 == 0, "--!").when(F.col("id") % 4 == 1, F.concat(F.lit("("), F.col("activity"), F.lit("#"), (F.col("id") % 3).cast("string"), F.lit(") "))).when(F.col("id") % 4 == 2, F.concat("activity", F.lit("_x"))).otherwise(F.col("activity"))).alias("x"))
)
query("x6_format_enabled", f" SELECT id, CASE WHEN id % 2 = 0 THEN substr({_ISO}, 1, 23) ELSE '' END AS x FROM e")(lambda x: x.e.select("id", X.format_enabled(F.when(F.col("id") % 2 == 0, F.col("start_time"))).alias("x")))
query("x7_consecutive_ids", (
    ", f AS (SELECT case_id, min(s) AS s, arg_min(id, {'s': s, 'id': id}) AS i FROM e GROUP BY 1)"
    ", n AS (SELECT case_id, row_number() OVER (ORDER BY s, i) - 1 AS case_no FROM f) SELECT id, case_no FROM e"
    " JOIN n USING (case_id)"
))(lambda x: P.consecutive_ids(x.e).select("id", "case_no"))
query("x8_iso_z", " SELECT id, strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%SZ') AS x FROM e")(lambda x: x.e.select("id", X.format_iso_z(F.col("start_time")).alias("x")))
query("x9_missing_to_null", " SELECT count(*) FILTER (id % 4 <> 0) AS n FROM e")(lambda x: x.e.agg(F.count(X.missing_to_null(F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).otherwise(1.0))).alias("n")))
query("x12_epoch_seconds", " SELECT id, CASE id % 3 WHEN 0 THEN round(s / 1e6, 3) WHEN 1 THEN (s - s % 1000000) / 1e6 END AS x FROM e")(
    lambda x: x.e.select("id", X.epoch_seconds(F.when(F.col("id") % 3 == 0, F.round(micros("start_time") / 1e6, 3).cast("decimal(20,3)").cast("string")).when(F.col("id") % 3 == 1, F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise("never")).alias("x"))
)
query("o1_order_in_case", " SELECT id, row_number() OVER (PARTITION BY case_id ORDER BY s, id)::INT AS pos FROM e")(lambda x: P.ordered(x.e).select("id", "pos"))

# Sources and sinks: what is written is read back


@query("s1_read_event_log", " SELECT id::VARCHAR AS id, case_id, activity, s AS start_time, t AS end_time FROM e")
def _(x):
    path = _folder(x, "log.csv")
    x.e.select("id", "case_id", "activity", "resource", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) for c in ("start_time", "end_time")]).write.option("compression", "gzip").csv(path, header=True)
    return micros_out(S.read_event_log(x.spark, path).select("id", "case_id", "activity", "start_time", "end_time"))


@query("s2_read_mapped", " SELECT (SELECT count(*) FROM e WHERE id % 9 = 0) AS missing_ends, count(*) AS n, min(s) AS a FROM e")
def _(x):
    path = _folder(x, "mapped.csv")
    x.e.select(F.col("case_id").alias("Case"), F.col("activity").alias("Activity"), F.col("resource").alias("Resource"), F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("Begin"), F.when(F.col("id") % 9 > 0, F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("EndTime")).write.csv(path, header=True)
    log, missing = S.read_mapped(x.spark, path, S.parse_mapping(x.spark, '{"Case": "CaseId", "Begin": "StartTime"}'))
    return missing.crossJoin(log.agg(F.count(F.lit(1)).alias("n"), F.min(micros("start_time")).alias("a")))


query("s3_canonical_columns", " SELECT case_id, activity, resource, s AS start_time, t AS end_time, case_type FROM e")(lambda x: micros_out(S.canonical(x.e)))


@query("s4_read_roles", " SELECT DISTINCT resource, role FROM r")
def _(x):
    path = _folder(x, "params.json")
    x.roles.groupBy(F.col("role").alias("name")).agg(F.collect_list(F.struct(F.col("resource").alias("id"))).alias("resource_list")).agg(F.collect_list(F.struct("name", "resource_list")).alias("resource_profiles")).write.json(path)
    return S.read_roles(x.spark, path)


@query("s5_s6_declared_attributes", (
    " SELECT 'case' AS family, 'case_type' AS names, (SELECT count(*) FROM e) AS rows UNION ALL"
    " SELECT 'event', 'activity', (SELECT count(*) FROM e) UNION ALL SELECT 'global', '', (SELECT count(*) FROM e)"
))
def _(x):
    path = _folder(x, "attributes.json")
    one = x.e.agg(F.count(F.lit(1)).alias("n"), F.array(F.struct(F.lit("case_type").alias("name")), F.struct(F.lit("case_type").alias("name"))).alias("case_attributes"), F.array(F.struct(F.lit("t").alias("event_id"), F.array(F.struct(F.lit("activity").alias("name")), F.struct(F.lit("absent").alias("name"))).alias("attributes"))).alias("event_attributes"))
    one.drop("n").write.json(path)
    there = F.array(*[F.lit(c) for c in x.e.columns])
    return S.declared_attributes(x.spark, path).select("family", F.array_join(F.array_intersect("names", there), ",").alias("names")).crossJoin(one.select(F.col("n").alias("rows")))


@query("s8_prefix", " SELECT case_id AS \"CaseId\", strftime(make_timestamp(s), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS \"StartTime\", case_type FROM e, p WHERE s < cut")
def _(x):
    path = _folder(x, "prefix.csv")
    S.write_csv(S.prefix(x.e, moment(x.cut)), path)
    return x.spark.read.csv(path, header=True).select("CaseId", "StartTime", "case_type")


@query("s10_s11_snapshot_ids", _SNAP + " SELECT DISTINCT case_id FROM sn")
def _(x):
    path = _folder(x, "snapshot")
    S.write_snapshot(path, _snapshot(x).select("case_id", "flows"), x.e.agg(F.max(micros("start_time")).alias("last_case_arrival")))
    return S.read_snapshot_ids(x.spark, path)


@query("s10_snapshot_round_trip", _P14 + (
    ", la AS (SELECT max(f) AS arrival FROM (SELECT min(s) AS f FROM e GROUP BY case_id)), gl AS (SELECT activity"
    " FROM e ORDER BY s DESC, id DESC LIMIT 1)"
    ", lt AS (SELECT case_id, array_to_string(list_sort(list(activity || ' ' || s)), ',') AS live FROM sn WHERE t IS NULL"
    " GROUP BY 1) SELECT ps.*, coalesce(live, '') AS live, arrival, gl.activity AS last_activity FROM ps LEFT"
    " JOIN lt USING (case_id), la, gl"
))
def _(x):
    """Everything that a snapshot has, written and read again: header, global attributes and the arrays of each case."""
    path, made = _folder(x, "snapshot"), _snapshot(x)
    last = P.global_attributes(x.e, ["activity"])
    arrival = x.e.groupBy("case_id").agg(F.min(micros("start_time")).alias("f")).agg(F.max("f").alias("last_case_arrival"))
    S.write_snapshot(path, made, arrival, last)
    head, cases = S.read_snapshot(x.spark, path, made.schema, last.schema)
    live = F.array_join(F.array_sort(F.transform("ongoing_activities", lambda a: F.concat(a["label"], F.lit(" "), F.unix_micros(a["start_time"]).cast("string")))), ",")
    return cases.crossJoin(F.broadcast(head)).select(
        "case_id", F.array_join("flows", " ").alias("flows"), F.size("ongoing_activities").alias("ongoing"), F.size("enabled_activities").alias("activities"), F.size("enabled_gateways").alias("gateways"),
        F.size("enabled_events").alias("events"), live.alias("live"), F.col("last_case_arrival").alias("arrival"), F.col("global_attributes.activity").alias("last_activity"),
    )


@query(
    "s9_s12_s14_outputs",
    (
        ", n AS (SELECT count(DISTINCT activity) AS a, count(*) AS n, sum((t - s) / 1e9) AS d FROM e) SELECT *"
        " FROM (SELECT 'results' AS name, a AS rows, round(d, 3) AS total FROM n UNION ALL"
        " SELECT 'utilisation', (SELECT count(DISTINCT role) FROM r), NULL FROM n UNION ALL SELECT 'models', a, round(n, 3)"
        " FROM n UNION ALL SELECT 'metadata', 1, round(n, 3) FROM n)"
    ),
)
def _(x):
    """Results and utilisation as tables, models and metadata as JSON: written, read again, and summed."""
    from tracework.operators.aggregates import utilisation

    path = _folder(x, "outputs")
    by = x.e.groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.sum((micros("end_time") - micros("start_time")) / 1e9).alias("value"))
    S.write_outputs(path, results=by.select("activity", "value"), utilisation=utilisation(x.e, x.roles, x.cut, x.end), models=by.select(F.lit("baseline").alias("method"), "activity", "n"), metadata=x.e.agg(F.count(F.lit(1)).alias("n"), F.lit("events").alias("log")))
    tables = {"results": (None, "value"), "utilisation": (None, None), "models": ("method string, activity string, n long", "n"), "metadata": ("n long, log string", "n")}
    out = None
    for name, (schema, total) in tables.items():
        part = S.read_output(x.spark, path, name, schema).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(total), 3).cast("double").alias("total") if total else F.lit(None).cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query("o2_sorted_sink", " SELECT id, row_number() OVER (ORDER BY s, id) - 1 AS place FROM e")
def _(x):
    path = _folder(x, "sorted")
    S.write_sorted(x.e.select("id", "start_time", "activity"), path)
    return S.read_places(x.spark, path).select("id", "place")


@query("o2_time_range", " SELECT id FROM e, p WHERE s >= cut AND s <= cut + 86400000000")
def _(x):
    """A day's rows, from the files that the manifest names."""
    path = _folder(x, "sorted")
    S.write_sorted(x.e.select("id", "start_time", "activity"), path, 1 << 20)
    return S.read_between(x.spark, path, moment(F.lit(x.cut)), moment(F.lit(x.cut + 86_400_000_000))).select("id")


@query(
    "s7_read_model",
    """, a AS (SELECT DISTINCT activity FROM e), b AS (SELECT activity, lead(activity) OVER (PARTITION BY case_id ORDER BY s, id) AS next FROM e),
d AS (SELECT DISTINCT activity, next FROM b WHERE next IS NOT NULL)
SELECT 'task' AS kind, 't_' || activity AS id, CASE WHEN activity < 'n' THEN activity ELSE 'Unnamed Task t_' || activity END AS name, NULL AS target FROM a
UNION ALL SELECT 'exclusiveGateway', 'g_' || activity, 'after ' || activity, NULL FROM a UNION ALL SELECT 'endEvent', 'end', 'Unnamed endEvent end', NULL
UNION ALL SELECT 'flow', 'f_' || activity, 't_' || activity, 'g_' || activity FROM a
UNION ALL SELECT 'flow', 'f_' || activity || '_' || next, 'g_' || activity, 't_' || next FROM d""",
)
def _(x):
    """A process model of the log (each activity a task before a gateway that leads to what follows it), written, and read again."""
    follows = x.e.select("activity", F.lead("activity").over(Window.partitionBy("case_id").orderBy("start_time", "id")).alias("next"))
    acts, pairs = x.e.select("activity").distinct(), follows.filter("next IS NOT NULL").distinct()  # as many as the log has activities, and pairs of them
    a, n = F.col("activity"), F.col("next")
    parts = [
        acts.select(F.format_string('<m:task id="t_%s"%s/>', a, F.when(a < "n", F.format_string(' name="%s"', a)).otherwise("")).alias("e")),
        acts.select(F.format_string('<m:exclusiveGateway id="g_%s" name="after %s"/><m:sequenceFlow id="f_%s" sourceRef="t_%s" targetRef="g_%s"/>', a, a, a, a, a).alias("e")),
        pairs.select(F.format_string('<m:sequenceFlow id="f_%s_%s" sourceRef="g_%s" targetRef="t_%s"/>', a, n, a, n).alias("e")),
    ]
    body = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.array_join(F.sort_array(F.collect_list("e")), "").alias("b"))
    head = '<m:definitions xmlns:m="http://www.omg.org/spec/BPMN/20100524/MODEL"><m:process id="p">'
    path = _folder(x, "model")
    body.select(F.concat(F.lit(head), "b", F.lit('<m:endEvent id="end"/></m:process></m:definitions>'))).coalesce(1).write.text(path)
    nodes, flows = S.read_model(x.spark, path)
    found = nodes.select("kind", F.col("node_id").alias("id"), "name", F.lit(None).cast("string").alias("target"))
    return found.unionByName(flows.select(F.lit("flow").alias("kind"), F.col("flow_id").alias("id"), F.col("source").alias("name"), "target"))


def _s14() -> str:
    """Each written table's name, rows and total."""
    from tracework.plans import analysis as Y

    parts = [
        "SELECT 'samples' AS name, count(*) AS rows, round(sum(wip), 6)::DOUBLE AS total FROM te",
        "SELECT 'evaluations', count(*), round(sum(abs(err)), 6) FROM ev WHERE baseline_in_ci IS NOT NULL",
        "SELECT 'models', (SELECT count(*) FROM g2) + (SELECT count(*) FROM g3) + 1, (SELECT sum(round(m, 6)) FROM (SELECT m FROM g1 UNION ALL SELECT m FROM g2 UNION ALL SELECT m FROM g3))",
        "SELECT 'metadata', 1, (SELECT count(*) FROM tr)",
        "SELECT 'joined', count(*), round(sum(wip), 6) FROM te JOIN ev USING (t) WHERE baseline_in_ci",
    ]
    return Y._SAMPLE + Y._EVAL + " SELECT name, rows, round(total, 6) AS total FROM (" + " UNION ALL ".join(parts) + ")"


@query("s14_experiment_outputs", _s14())
def _(x):
    """Cut samples, their evaluation, the groups of each method and what the run was: written together, read again, and joined."""
    from tracework.operators import models as MO
    from tracework.plans.analysis import _sampled

    path, (train, test) = _folder(x, "outputs"), _sampled(x)
    iso = F.date_format(moment(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("cut_time_iso")
    edges = MO.wip_edges(train, "err")
    groups = {"baseline": MO.baseline(train, "err").withColumn("group_id", F.lit(0)), "random_groups": MO.random_groups(train, "err"), "wip_deciles": MO.wip_groups(train, "err", edges)}
    models = None
    for method, df in groups.items():
        part = df.select(F.lit(method).alias("method"), F.col("group_id").cast("int").alias("group_id"), F.round("mean", 6).alias("mean"), "ci", F.col("count").alias("n"))
        models = part if models is None else models.unionByName(part)
    S.write_outputs(
        path,
        samples=test.select(iso, F.lit("test").alias("split"), "wip", "err"),
        evaluations=MO.simple_methods(train, test, "err").select(iso, F.col("err").alias("true_error"), "baseline_mean", "baseline_ci", "baseline_in_ci"),
        models=models,
        metadata=train.agg(F.lit("remaining hours").alias("target"), F.count(F.lit(1)).alias("n_train")),
    )
    samples, evaluations = (S.read_output(x.spark, path, n) for n in ("samples", "evaluations"))
    back = S.read_output(x.spark, path, "models", "method string, group_id int, mean double, ci double, n long")
    meta = S.read_output(x.spark, path, "metadata", "target string, n_train long")
    joined = MO.joined_samples(samples, evaluations).filter("baseline_in_ci")
    total = lambda name, df, c: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(c).cast("double").alias("total"))
    out = total("samples", samples, F.col("wip")).unionByName(total("evaluations", evaluations.filter("baseline_in_ci IS NOT NULL"), F.abs("true_error")))
    return out.unionByName(total("models", back, F.col("mean"))).unionByName(total("metadata", meta, F.col("n_train"))).unionByName(total("joined", joined, F.col("wip")))


def _s13() -> str:
    """The rankings' SQL, with the intervals' of 20 draws beside it."""
    from tracework.plans import analysis as Y

    points = Y.SQL["r5_rankings"].removeprefix(BASE).removeprefix(Y._RES)
    cut = points.index(" SELECT 'A' AS scope")
    return Y._RES + points[:cut] + ", pt AS (" + points[cut + 1 :] + ")" + Y._DRAWS.format(n=20) + f", ci AS (SELECT scope, family, metric, {Y._CI} FROM bt GROUP BY ALL) SELECT * FROM pt JOIN ci USING (scope, family, metric)"


@query("s13_recompute_rankings", _s13())
def _(x):
    from tracework.plans.analysis import _results

    path = _folder(x, "rankings")
    S.write_outputs(path, results=_results(x))
    return S.recompute_rankings(x.spark, f"{path}/results", f"{path}/rankings", 20)


@query("x4_fixed_log", f" SELECT id::VARCHAR AS id, CASE WHEN id % 6 > 0 THEN substr({_ISO}, 1, 23) END AS start_time FROM e")
def _(x):
    path = _folder(x, "broken.csv")
    x.e.select("id", F.when(F.col("id") % 6 == 0, "unknown").otherwise(F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")).alias("start_time"), F.lit("2024-01-01T00:00:00Z").alias("enabled_time")).write.csv(path, header=True)
    return S.fixed_log(x.spark, path)[0].select("id", "start_time")


# Joins and set operations

query("j2_semi_join", " SELECT id FROM e WHERE case_id IN (SELECT case_id FROM g WHERE activity = 'rework')")(lambda x: x.e.join(x.g.filter("activity = 'rework'"), "case_id", "left_semi").select("id"))
query("j3_anti_join", " SELECT id FROM e WHERE case_id NOT IN (SELECT case_id FROM g WHERE activity = 'rework')")(lambda x: x.e.join(x.g.filter("activity = 'rework'"), "case_id", "left_anti").select("id"))
query("j4_role_lookup", " SELECT id, coalesce(CASE WHEN role <> 'role2' THEN role END, 'unknown') AS role FROM e LEFT JOIN r USING (resource)")(lambda x: M.with_role(x.e, x.roles.filter("role <> 'role2'"), "unknown").select("id", "role"))
query("j5_multiset_alignment", (
    ", a AS (SELECT activity, count(*) AS n FROM e GROUP BY 1), b AS (SELECT activity, count(*) AS m FROM g GROUP BY 1)"
    " SELECT activity, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b USING (activity)"
))(
    lambda x: x.e.select("activity", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(x.g.select("activity", F.lit(0).alias("n"), F.lit(1).alias("m"))).groupBy("activity").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
)
query("u1_boundary_union", " SELECT count(*) AS n FROM (SELECT s AS t FROM e UNION SELECT t FROM e UNION SELECT s FROM g UNION SELECT t FROM g)")(
    lambda x: x.e.unionByName(x.g).select(F.explode(F.array("start_time", "end_time")).alias("t")).groupBy("t").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("n"))
)
query("u2_tagged_concat", " SELECT tag, activity, count(*) AS n FROM (SELECT 'a' AS tag, activity FROM e UNION ALL SELECT 'b', activity FROM g) GROUP BY ALL")(lambda x: x.e.withColumn("tag", F.lit("a")).unionByName(x.g.withColumn("tag", F.lit("b"))).groupBy("tag", "activity").agg(F.count(F.lit(1)).alias("n")))
query("u3_empty_concat", " SELECT count(*) AS n FROM e")(lambda x: x.e.filter(F.lit(False)).unionByName(x.e).agg(F.count(F.lit(1)).alias("n")))
query("u4_id_union", " SELECT case_id FROM e WHERE activity = 'view' UNION SELECT case_id FROM g WHERE activity = 'rework'")(lambda x: x.e.filter("activity = 'view'").select("case_id").union(x.g.filter("activity = 'rework'").select("case_id")).distinct())
query("u5_overlap", " SELECT case_id, bool_or(activity IN ('view', 'click')) AS hit FROM e GROUP BY 1")(lambda x: x.e.groupBy("case_id").agg(F.arrays_overlap(F.collect_set("activity"), F.array(F.lit("view"), F.lit("click"))).alias("hit")))
