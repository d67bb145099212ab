"""Process state of every running case at a cut: what is ongoing, where tokens lie, what is enabled since when.

The process model comes as tables nodes (node_id, kind, name) and flows (flow_id, source, target), the search index over traces
as a table marking_index (gram, marking). These are small; they are broadcast by Spark where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.functions.scalar import HOUR, micros, moment
from tracework.operators.running import ROWS_A_RANGE, large_keys, running
from tracework.sources.files import stored

TASK, GATEWAY = "task", "exclusiveGateway"
EVENTS = ("startEvent", "intermediateCatchEvent", "intermediateThrowEvent", "endEvent")
START, SUFFIX = "<start>", 20


def filled_ends(log: DataFrame) -> DataFrame:
    """Open ends set to an hour after the last end, while concurrency is learnt."""
    last = log.agg(F.max("end_time").alias("_last"))
    return log.crossJoin(F.broadcast(last)).withColumn("end_time", F.coalesce("end_time", moment(micros("_last") + HOUR))).drop("_last")


def ends_before(log: DataFrame) -> DataFrame:
    """(case_id, id, a, b, n, last): for each instance (of activity a) and each activity b of its case, how many other instances of b have
    ended by its start, and when the last of them did.

    Rows grow with instances times the activities of a case, not with pairs of instances: starts and ends of one case and activity
    are run through in order of time. No instance may end before it starts.
    """
    rows = log.select("case_id", "id", F.col("activity").alias("a"), micros("start_time").alias("s"), micros("end_time").alias("t"))
    each = rows.join(rows.groupBy("case_id").agg(F.collect_set("a").alias("acts")), "case_id").withColumn("b", F.explode("acts"))
    own = F.when((F.col("a") == F.col("b")) & (F.col("t") == F.col("s")), 1).otherwise(0)
    starts = each.select("case_id", "id", "a", "b", F.col("s").alias("at"), F.lit(None).cast("long").alias("end"), own.alias("own"))
    ends = rows.select("case_id", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), F.lit(None).cast("string").alias("a"), F.col("a").alias("b"), F.col("t").alias("at"), F.col("t").alias("end"), F.lit(0).alias("own"))
    w = Window.partitionBy("case_id", "b").orderBy("at")
    upto, earlier, here = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(0, 0)
    seen = starts.unionByName(ends).withColumns({"n": F.count("end").over(upto) - F.col("own"), "_here": F.count("end").over(here) - F.col("own"), "_earlier": F.max("end").over(earlier)})
    return seen.filter("id IS NOT NULL").select("case_id", "id", "a", "b", "n", F.when(F.col("_here") > 0, F.col("at")).otherwise(F.col("_earlier")).alias("last"))


def concurrent_pairs(log: DataFrame, threshold: float = 0.5, before: DataFrame | None = None) -> DataFrame:
    """(a, b): activities of which, in cases with both, at least a share of pairs of instances overlap in time [published definition].

    Pairs are counted, never made: all of a case less those of which one has ended by the other's start (`before`: ends_before(log)).
    """
    other = lambda x, n: x.withColumnsRenamed({"a": "b", "n": n})
    sizes = log.groupBy("case_id", F.col("activity").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.join(other(sizes, "m"), "case_id").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    apart = (before if before is not None else ends_before(log)).filter("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    apart = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("apart"))
    # Two instances of no length at one time have both ended by the other's start: counted twice.
    points = log.filter("start_time = end_time").groupBy("case_id", "start_time", F.col("activity").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    twice = points.join(other(points, "m"), ["case_id", "start_time"]).filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("twice"))
    share = (F.col("total") - F.coalesce("apart", F.lit(0)) + F.coalesce("twice", F.lit(0))) / F.col("total")
    return total.join(apart, ["a", "b"], "left").join(twice, ["a", "b"], "left").filter(share >= threshold).select("a", "b")


def enabled_times(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    """log with enable_time: the last end, by an instance's start, of its case's activities that are not concurrent with it; else the case's first start.

    A log that has the column keeps it.
    """
    if "enable_time" in log.columns:
        return log
    whole = filled_ends(log)
    before = ends_before(whole)
    near = before.filter("last IS NOT NULL").join(concurrent_pairs(whole, threshold, before), ["a", "b"], "left_anti")
    since = near.groupBy("id").agg(F.max("last").alias("_since"))
    first = whole.groupBy("case_id").agg(F.min(micros("start_time")).alias("_first"))
    return log.join(since, "id", "left").join(first, "case_id").withColumn("enable_time", moment(F.coalesce("_since", "_first"))).drop("_since", "_first")


def row_attributes(names: list[str]) -> Column:
    """The values of a row's attributes that are not null, as a map of texts."""
    if not names:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull())


def _by_start() -> Column:
    return F.struct("start_time", "id")


def case_attributes(log: DataFrame, names: list[str]) -> DataFrame:
    """(case_id, names): the first known value of each attribute, by start."""
    return log.groupBy("case_id").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), _by_start())).alias(n) for n in names])


def latest_attributes(log: DataFrame, names: list[str], keys: list[str] = ["case_id"]) -> DataFrame:  # noqa: B006
    """(keys, names): the values of the last row by start; null there is null."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*names), _by_start()).alias("_last")).select(*keys, "_last.*")


def ongoing_activities(log: DataFrame, nodes: DataFrame, attributes: list[str] = ()) -> DataFrame:
    """(case_id, node_id, label, start_time, resource, enabled_time, event_attributes) of open rows; no enabled time without a node."""
    tasks = nodes.filter(F.col("kind") == TASK).groupBy(F.col("name").alias("activity")).agg(F.min("node_id").alias("node_id"))
    open_ = log.filter("end_time IS NULL").join(tasks, "activity", "left")
    return open_.select("case_id", "node_id", F.col("activity").alias("label"), "start_time", "resource", F.when(F.col("node_id").isNotNull(), F.col("enable_time")).alias("enabled_time"), row_attributes(list(attributes)).alias("event_attributes"))


def traces(log: DataFrame) -> DataFrame:
    """(case_id, trace): starts and completions in time order, earlier rows first on a tie, after a start token."""
    kinds = F.array(F.struct(micros("start_time").alias("t"), F.col("start_time").alias("o"), F.col("id").alias("id"), F.lit(0).alias("p"), F.concat("activity", F.lit("+START")).alias("label")), F.struct(micros("end_time").alias("t"), F.col("start_time").alias("o"), F.col("id").alias("id"), F.lit(1).alias("p"), F.concat("activity", F.lit("+COMPLETE")).alias("label")))
    each = log.select("case_id", F.explode(kinds).alias("e")).filter("e.t IS NOT NULL")
    return each.groupBy("case_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("case_id", F.concat(F.array(F.lit(START)), F.transform("e", lambda x: x["label"])).alias("trace"))


def suffix_hashes(trace: Column, longest: int) -> Column:
    """(k, h1, h2) of the last k labels, for k up to a length: chained from the end, so that a suffix costs one step more than the one before."""
    last = F.slice(F.reverse(trace), 1, longest)
    start = F.array().cast("array<struct<k: int, h1: bigint, h2: bigint>>")

    def longer(done: Column, label: Column) -> Column:
        before = F.get(done, F.size(done) - 1)
        step = F.named_struct(F.lit("k"), F.size(done) + 1, F.lit("h1"), F.xxhash64(label, before["h1"]), F.lit("h2"), F.xxhash64(F.lit("~"), label, before["h2"]))
        return F.concat(done, F.array(step))

    return F.aggregate(last, start, longer)


def unique_grams(index: DataFrame, longest: int = SUFFIX) -> DataFrame:
    """(k, h1, h2, marking) of the index's grams with one marking; those with several say nothing and are set aside."""
    known = index.filter((F.size("gram") > 0) & (F.size("gram") <= longest)).withColumn("g", F.try_element_at(suffix_hashes(F.col("gram"), longest), F.lit(-1)))
    same = known.groupBy("g.k", "g.h1", "g.h2").agg(F.min("marking").alias("marking"), F.max("marking").alias("other"))
    return same.filter("k IS NOT NULL AND marking = other").drop("other")


def markings(trace: DataFrame, index: DataFrame, longest: int = SUFFIX) -> DataFrame:
    """(case_id, marking): that of the longest suffix of the trace, up to a length, which the index knows with one marking only
    [published definition]; none: empty. Suffixes meet the index by 128 bits of hash, not as arrays."""
    suffixes = trace.select("case_id", F.explode(suffix_hashes(F.col("trace"), longest)).alias("g")).select("case_id", "g.*")
    found = suffixes.join(unique_grams(index, longest), ["k", "h1", "h2"]).groupBy("case_id").agg(F.max_by("marking", "k").alias("marking"))
    return trace.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("marking", F.array().cast("array<string>")).alias("marking"))


def repaired(marking: DataFrame, ongoing: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """(case_id, kind, element): marked flows; marked activities that are ongoing; for other marked activities their incoming flows."""
    each = marking.select("case_id", F.explode("marking").alias("element"))
    flow = each.join(flows.select(F.col("flow_id").alias("element")), "element", "left_semi").select("case_id", F.lit("flow").alias("kind"), "element")
    act = each.join(nodes.filter(F.col("kind") == TASK).select(F.col("node_id").alias("element")), "element", "left_semi")
    live = ongoing.select("case_id", F.col("node_id").alias("element")).distinct()
    kept = act.join(live, ["case_id", "element"], "left_semi").select("case_id", F.lit("activity").alias("kind"), "element")
    gone = act.join(live, ["case_id", "element"], "left_anti").join(flows, F.col("element") == F.col("target")).select("case_id", F.lit("flow").alias("kind"), F.col("flow_id").alias("element"))
    return flow.unionByName(kept).unionByName(gone).distinct()


def enabled_since(log: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, name, enabled): when an activity that would start now became enabled: the last end of finished, not concurrent
    work; the case's first start if nothing is finished or all is concurrent."""
    first = log.groupBy("case_id").agg(F.min(micros("start_time")).alias("first"))
    done = log.filter("end_time IS NOT NULL").groupBy("case_id", F.col("activity").alias("b")).agg(F.max(micros("end_time")).alias("t"))
    near = names.join(done, "case_id").join(pairs.select(F.col("a").alias("name"), "b"), ["name", "b"], "left_anti").groupBy("case_id", "name").agg(F.max("t").alias("t"))
    return names.join(first, "case_id").join(near, ["case_id", "name"], "left").select("case_id", "name", F.coalesce("t", "first").alias("enabled"))


def _targets(state: DataFrame, flows: DataFrame, nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    at = state.filter("kind = 'flow'").join(flows.select(F.col("flow_id").alias("element"), F.col("target").alias("node_id")), "element").select("case_id", "node_id")
    return at.join(nodes.filter(F.col("kind").isin(*kinds)), "node_id").select("case_id", "node_id", "name").distinct()


def enabled_activities(log: DataFrame, state: DataFrame, nodes: DataFrame, flows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, node_id, enabled): tasks behind marked flows."""
    at = _targets(state, flows, nodes, (TASK,))
    return at.join(enabled_since(log, at.select("case_id", "name").distinct(), pairs), ["case_id", "name"]).select("case_id", "node_id", "enabled")


def enabled_events(log: DataFrame, state: DataFrame, nodes: DataFrame, flows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, node_id, enabled): events behind marked flows, end events too."""
    at = _targets(state, flows, nodes, EVENTS)
    return at.join(enabled_since(log, at.select("case_id", "name").distinct(), pairs), ["case_id", "name"]).select("case_id", "node_id", "enabled")


def upstream_tasks(nodes: DataFrame, flows: DataFrame, kind: str = GATEWAY) -> DataFrame:
    """(node_id, task): tasks from which a node is reached through gateways and events alone. Cycles end as nodes are visited once."""
    kinds = nodes.select(F.col("node_id").alias("at"), F.col("kind").alias("at_kind"))
    back = flows.select(F.col("target").alias("at"), F.col("source").alias("to"))
    seen = nodes.filter(F.col("kind") == kind).select("node_id", F.col("node_id").alias("at"))
    front = seen
    while True:  # each round finds new pairs of the model's graph, which is finite
        step = front.join(kinds, "at").filter(F.col("at_kind") != TASK).join(back, "at").select("node_id", F.col("to").alias("at")).distinct()
        rows = [(r["node_id"], r["at"]) for r in step.join(seen, ["node_id", "at"], "left_anti").collect()]  # the model's graph, not the log
        if not rows:
            break
        front = nodes.sparkSession.createDataFrame(rows, "node_id string, at string")
        seen = seen.unionByName(front)
    return seen.join(kinds, "at").filter(F.col("at_kind") == TASK).select("node_id", F.col("at").alias("task"))


def enabled_gateways(log: DataFrame, state: DataFrame, nodes: DataFrame, flows: DataFrame, upstream: DataFrame) -> DataFrame:
    """(case_id, node_id, enabled): exclusive gateways behind marked flows without ongoing upstream tasks.

    Enabled at the last end of upstream tasks, else of any, else at the case's first start.
    """
    at = _targets(state, flows, nodes, (GATEWAY,)).select("case_id", "node_id")
    live = state.filter("kind = 'activity'").select("case_id", F.col("element").alias("task")).join(upstream, "task").select("case_id", "node_id").distinct()
    at = at.join(live, ["case_id", "node_id"], "left_anti")
    names = upstream.join(nodes.select(F.col("node_id").alias("task"), F.col("name").alias("activity")), "task").select("node_id", "activity").distinct()
    done = log.filter("end_time IS NOT NULL").groupBy("case_id", "activity").agg(F.max(micros("end_time")).alias("t"))
    own = at.join(names, "node_id").join(done, ["case_id", "activity"]).groupBy("case_id", "node_id").agg(F.max("t").alias("own"))
    any_ = log.groupBy("case_id").agg(F.max(micros("end_time")).alias("any"), F.min(micros("start_time")).alias("first"))
    return at.join(any_, "case_id").join(own, ["case_id", "node_id"], "left").select("case_id", "node_id", F.coalesce("own", "any", "first").alias("enabled"))


def without_finished(cases: DataFrame, gateways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cases none of whose enabled gateways is an end event."""
    over = gateways.join(nodes.filter(F.col("kind") == "endEvent"), "node_id", "left_semi").select("case_id").distinct()
    return cases.join(over, "case_id", "left_anti")


def snapshot(log: DataFrame, nodes: DataFrame, flows: DataFrame, index: DataFrame, case_names: list[str] = (), event_names: list[str] = ()) -> DataFrame:
    """One row per running case of a prepared log: flows, activities, ongoing_activities, enabled_*, case_ and event_attributes."""
    log = stored(enabled_times(log))
    pairs = stored(concurrent_pairs(filled_ends(log)))
    ongoing = ongoing_activities(log, nodes, list(event_names))
    state = stored(repaired(markings(traces(log), index), ongoing, nodes, flows))
    gates = enabled_gateways(log, state, nodes, flows, upstream_tasks(nodes, flows))

    def listed(df: DataFrame, name: str) -> DataFrame:
        item = F.struct(F.col("node_id").alias("id"), moment(F.col("enabled")).alias("enabled_time"))
        return df.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias(name))

    own = lambda kind, name: state.filter(F.col("kind") == kind).groupBy("case_id").agg(F.array_sort(F.collect_set("element")).alias(name))
    out = without_finished(log.select("case_id").distinct(), gates, nodes)
    parts = [
        own("flow", "flows"), own("activity", "activities"),
        ongoing.groupBy("case_id").agg(F.collect_list(F.struct(F.col("node_id").alias("id"), "label", "start_time", "resource", "enabled_time", "event_attributes")).alias("ongoing_activities")),
        listed(enabled_activities(log, state, nodes, flows, pairs), "enabled_activities"), listed(gates, "enabled_gateways"), listed(enabled_events(log, state, nodes, flows, pairs), "enabled_events"),
    ]
    if case_names:
        parts.append(case_attributes(log, list(case_names)).select("case_id", row_attributes(list(case_names)).alias("case_attributes")))
    if event_names:
        parts.append(latest_attributes(log, list(event_names)).select("case_id", row_attributes(list(event_names)).alias("event_attributes")))
    for p in parts:
        out = out.join(p, "case_id", "left")
    lists = [c for c, kind in out.dtypes if kind.startswith("array")]
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in lists})


def global_attributes(log: DataFrame, names: list[str]) -> DataFrame:
    """(names): the values of the log's last row by start."""
    return log.agg(F.max_by(F.struct(*names), _by_start()).alias("_last")).select("_last.*")


def consecutive_ids(log: DataFrame) -> DataFrame:
    """log with case_no: case ids as consecutive whole numbers, in the order in which they are first seen."""
    from tracework.operators.windows import numbered

    first = log.groupBy("case_id").agg(F.min(F.struct(micros("start_time").alias("t"), F.col("id").alias("id"))).alias("f"))
    order = F.concat(F.lpad(F.col("f.t").cast("string"), 20, "0"), F.lpad(F.col("f.id").cast("string"), 20, "0"))
    return log.join(numbered(first.select("case_id", order.alias("_o")), "_o").select("case_id", F.col("n").alias("case_no")), "case_id")


def ordered(log: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """log with pos: each row's place in its case, by start, the id ending ties; a very long case is counted in ranges."""
    if not large_keys(log, ["case_id"], rows_a_range)[1]:
        return log.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("start_time", "id")))
    placed = log.withColumns({"_o": F.struct("start_time", "id"), "_one": F.lit(1)})
    return running(placed, ["case_id"], "_o", ["_one"], rows_a_range).withColumn("pos", F.col("run__one").cast("int")).drop("_o", "_one", "run__one", "next__o")
