"""Mismatch of two logs under eight views: Bray-Curtis distance over time, and which keys contribute.

Input are events as `windows.normalise_events` makes them: times in seconds. The sweep is that of the state metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.operators.running import MOST_RANGES, ROWS_A_RANGE, range_within, running
from tracework.operators.sweep import Sweep, exploded, key_names
from tracework.operators.windows import fill_enable, normalise_events, normalise_times
from tracework.sources.scratch import stored

VIEWS = ("activity", "activity_case", "activity_resource", "activity_case_resource", "resource", "case", "activity_role", "activity_phase")
#: What differs where a part of a view's key does.
PARTS = {"activity": "what is done", "case": "which cases are active", "resource": "who does it", "role": "which roles do it", "phase": "how long work waits or takes"}


def hint(view: Column) -> Column:
    """What a high score of a view points to, from the parts of its key."""
    said = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
    return F.concat(F.lit("the logs differ in "), F.array_join(F.transform(F.split(view, "_"), lambda p: said[p]), " and "))


def has_enable(*events: DataFrame) -> bool:
    """Whether any event was enabled before it began; one row per log on the driver."""
    return any(e.agg(F.bool_or(F.col("enable") < F.col("start")).alias("x")).first()["x"] for e in events)


def select_views(names: list[str] | None, a: DataFrame, b: DataFrame, role_mapping: bool, enabled: bool = False) -> list[str]:
    """Canonical names of the wanted views, or all; those that lack roles or enable times are left out, unknown ones too.

    enabled: that there are enable times is known; otherwise the events are asked.
    """
    wanted = [n.strip().lower().replace("-", "_") for n in names] if names else list(VIEWS)
    wanted = [v for v in wanted if v in VIEWS and (v != "activity_role" or role_mapping)]
    return wanted if "activity_phase" not in wanted or enabled or has_enable(a, b) else [v for v in wanted if v != "activity_phase"]


def _text(*parts: Column) -> Column:
    return F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def spans(a: DataFrame, b: DataFrame, views: list[str], role_mapping: bool = False, case_mode: str = "interval") -> tuple[DataFrame, Column]:
    """Events, waiting times and cases with s, t and side, one row each, one scan a log, and their (view, key), key an array of texts."""
    act, case, res, role = (F.col(c) for c in ("activity", "case_id", "resource", "role"))
    keys = {
        "activity": _text(act), "activity_case": _text(act, case), "activity_resource": _text(act, res), "activity_case_resource": _text(act, case, res),
        "resource": _text(role if role_mapping else res), "activity_role": _text(act, role), "case": _text(case), "activity_phase": _text(act, F.lit("processing")),
    }
    plain = _plain(views, case_mode)
    cols = ["activity", "case_id", "resource", "role"]

    def one(x: DataFrame, side: int) -> DataFrame:
        kind = lambda k, s, t: F.struct(F.lit(k).alias("kind"), s.alias("s"), t.alias("t"))
        kinds = [kind("event", F.col("start"), F.col("end"))] if plain else []
        if "activity_phase" in views:
            kinds.append(F.when(F.col("enable") < F.col("start"), kind("wait", F.col("enable"), F.col("start"))))
        out = x.select(*cols, F.explode(F.array(*kinds)).alias("i")).filter("i IS NOT NULL").select(*cols, "i.*") if kinds else None
        if "case" in views and case_mode == "interval":
            none = [F.lit(None).cast("string").alias(c) for c in cols if c != "case_id"]
            cases = x.groupBy("case_id").agg(F.min("start").alias("s"), F.max("end").alias("t")).select("case_id", *none, F.lit("case").alias("kind"), "s", "t")
            out = cases if out is None else out.unionByName(cases)
        return out.withColumn("side", F.lit(side))

    item = lambda v, k: F.struct(F.lit(v).alias("view"), k.alias("key"))
    of_kind = F.when(F.col("kind") == "wait", F.array(item("activity_phase", _text(act, F.lit("waiting"))))).when(F.col("kind") == "case", F.array(item("case", keys["case"])))
    return one(a, 0).unionByName(one(b, 1)), of_kind.otherwise(F.array(*[item(v, keys[v]) for v in plain])) if plain else of_kind


def _plain(views: list[str], case_mode: str) -> list[str]:
    """Views of events alone."""
    return [v for v in views if v != "case" or case_mode == "running"]


def parts_of(views: list[str], role_mapping: bool, case_mode: str) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """View to the columns of its key and the kinds of spans() it counts, as the keys of spans() have them."""
    named = {"case": ("case_id",), "resource": ("role" if role_mapping else "resource",), "activity_phase": ("activity", "phase")}
    kinds = {"activity_phase": ("event", "wait")} | ({} if "case" in _plain(["case"], case_mode) else {"case": ("case",)})
    column = {"case": "case_id"}
    return {v: (named.get(v) or tuple(column.get(p, p) for p in v.split("_")), kinds.get(v, ("event",))) for v in views}


def intervals(a: DataFrame, b: DataFrame, views: list[str], role_mapping: bool = False, case_mode: str = "interval") -> DataFrame:
    """(view, key, s, t, side), key an array of texts: events under each view, one scan a log."""
    return exploded(*spans(a, b, views, role_mapping, case_mode))


def swept(a: DataFrame, b: DataFrame, views: list[str], role_mapping: bool = False, case_mode: str = "interval") -> Sweep:
    """The sweep of two logs' events under some views."""
    rows, keys = spans(a, b, views, role_mapping, case_mode)
    rows = rows.withColumn("phase", F.when(F.col("kind") == "wait", "waiting").when(F.col("kind") == "event", "processing"))
    return Sweep(rows, keys=keys, views=parts_of(views, role_mapping, case_mode))


def timeline(sweep: Sweep) -> DataFrame:
    """(view, start, end, duration, distance, total) between change points of each view."""
    return _line(sweep.ranged_steps).drop("_range")


def _line(steps: DataFrame) -> DataFrame:
    s = steps.filter("next_t IS NOT NULL")
    distance = F.when(F.col("total") > 0, F.col("apart") / F.col("total")).otherwise(0.0)
    return s.select("view", F.col("t").alias("start"), F.col("next_t").alias("end"), (F.col("next_t") - F.col("t")).alias("duration"), distance.alias("distance"), "total", "_range")


def scores(line: DataFrame) -> DataFrame:
    """(view, overall_score): distances weighted by duration, over the time from a view's first boundary to its last."""
    return line.groupBy("view").agg(F.coalesce(F.try_divide(F.sum(F.col("distance") * F.col("duration")), F.max("end") - F.min("start")), F.lit(0.0)).alias("overall_score"))


def swept_scores(sweep: Sweep) -> DataFrame:
    """scores() of a sweep, without a row for each boundary of the timeline. Areas are added range by range, so that equal ones stay equal."""
    if not sweep.views or sweep.wide is None:
        return scores(_line(sweep.stretches))
    parts = F.array_sort(F.collect_list(F.struct("_range", "value")))  # a row a range
    area = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["value"])
    own = sweep.areas(False).filter("key IS NULL").groupBy("view").agg(area.alias("area"), (F.max("last") - F.min("first")).alias("span"))
    return own.select("view", F.coalesce(F.try_divide("area", "span"), F.lit(0.0)).alias("overall_score"))


def key_steps(sweep: Sweep) -> DataFrame:
    """(view, _range, k1, k2, start, end, apart): stretches over which a key's counts differ by a constant amount, cut where ranges are."""
    keyed = sweep.keyed.withColumn("_range", F.lit(0)) if sweep.cut is None else sweep.changes
    out = keyed.withColumn("apart", F.abs(F.col("run_da") - F.col("run_db")))
    return out.filter("apart <> 0 AND next_at > at").select("view", "_range", "k1", "k2", F.col("at").alias("start"), F.col("next_at").alias("end"), "apart")


def contributors(sweep: Sweep) -> DataFrame:
    """(view, key, contribution, share): each key's part of the area under the distance.

    With F the running integral of 1 / total over a view's timeline, a key that is apart by c on [s, e) contributes c (F(e) - F(s)): a
    sum of F over the key's boundaries, each times what the key is less apart from then on. In a range F is a running sum along it;
    where boundaries are dealt by keys, both ends are points of the timeline, so two equal joins do.
    """
    parts = key_areas(sweep)
    if "key" in parts.columns:
        total = sweep.areas(True).filter("key IS NULL").groupBy("view").agg(F.sum("value").alias("all"))  # a view's area is that of its keys
    else:
        total = parts.groupBy("view").agg(F.sum("contribution").alias("all"))
        parts = parts.join(key_names(sweep.found), ["view", "k1", "k2"], "left")
    return parts.join(total, "view").select("view", "key", "contribution", (F.col("contribution") / F.col("all")).alias("share"))


def key_areas(sweep: Sweep) -> DataFrame:
    """(view, key or its hashes k1 and k2, contribution) of contributors()."""
    if sweep.views and sweep.wide is not None:
        found = sweep.areas(True).filter("key IS NOT NULL")
        # Most keys are in one range: rows are not combined before they are sent, and a task gets about so many keys.
        return found.repartition(-(-found.count() // ROWS_A_RANGE) or 1, "view", "key").groupBy("view", "key").agg(F.sum("value").alias("contribution"))
    if sweep.cut is None:
        w = F.when(F.col("total") > 0, (F.col("next_t") - F.col("t")) / F.col("total")).otherwise(0.0)
        s = sweep.steps.select("view", "t", F.coalesce(w, F.lit(0.0)).alias("w"))
        area = running(s, ["view"], "t", ["w"], sweep.rows_a_range, most=sweep.most).select("view", "t", (F.col("run_w") - F.col("w")).alias("f"))
        k = key_steps(sweep)
        k = k.join(area.select("view", F.col("t").alias("start"), F.col("f").alias("f0")), ["view", "start"]).join(area.select("view", F.col("t").alias("end"), F.col("f").alias("f1")), ["view", "end"])
        return k.groupBy("view", "k1", "k2").agg(F.sum(F.col("apart") * (F.col("f1") - F.col("f0"))).alias("contribution"))
    w = F.when((F.col("next_t") > F.col("t")) & (F.col("total") > 0), (F.col("next_t") - F.col("t")) / F.col("total")).otherwise(0.0)
    before = Window.partitionBy("view", "_range").orderBy("t", "real").rowsBetween(Window.unboundedPreceding, -1)
    k = sweep.placed.withColumn("w", w).withColumn("f", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return k.groupBy("view", "k1", "k2").agg(F.sum(-F.col("apart_by") * F.col("f")).alias("contribution"), F.max("differs").alias("differs")).filter("differs").drop("differs")


def ranked(parts: DataFrame, most: int) -> DataFrame:
    """The first `most` contributors of each view with their rank; ties by key. The limit is the feature."""
    w = Window.partitionBy("view").orderBy(F.desc("contribution"), "key")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def interval_contributors(sweep: Sweep, k: int, rows_a_range: int = 500) -> DataFrame:
    """(view, start, end, rank, key, contribution, share): the k largest contributors of every interval.

    Stretches meet the intervals they span by range of the axis, an equal join, then by time. Of the stretches that span a whole
    range only the k largest can be among the first k of any of its intervals; all others end or begin in the range, so that an
    interval meets at most k and as many as its range has boundaries. Equal amounts are told apart by the key's parts.
    """
    line = _line(sweep.ranged_steps)
    sizes = line.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    k_bins = max(1, min(MOST_RANGES, sizes // rows_a_range))
    places = [i / k_bins for i in range(1, k_bins)] or [0.5]
    bins = F.broadcast(stored(line.groupBy("_range").agg(F.percentile_approx("start", places, 10 * k_bins).alias("_cut"))))  # a row a range
    bin_of = lambda c: range_within(F.col(c), F.col("_cut"), len(places))
    named = key_steps(sweep).join(key_names(sweep.found), ["view", "k1", "k2"])
    spans = named.select("view", "_range", "key", "apart", F.col("start").alias("a"), F.col("end").alias("b")).join(bins, "_range")
    spans = spans.withColumns({"ra": bin_of("a"), "rb": bin_of("b")})
    cols = ["view", "_range", "key", "apart", "a", "b", "r"]
    ends = spans.withColumn("r", F.explode(F.array_distinct(F.array("ra", "rb")))).select(*cols)
    whole = spans.filter("rb > ra + 1").withColumn("r", F.explode(F.sequence(F.col("ra") + 1, F.col("rb") - 1))).select(*cols)
    most = F.row_number().over(Window.partitionBy("view", "_range", "r").orderBy(F.desc("apart"), "key"))
    whole = whole.withColumn("most", most).filter(F.col("most") <= k).select(*cols)
    each = line.join(bins, "_range").withColumn("r", bin_of("start")).drop("_cut").join(ends.unionByName(whole), ["view", "_range", "r"]).filter((F.col("start") >= F.col("a")) & (F.col("start") < F.col("b")))
    each = each.withColumn("share", F.col("apart") / F.col("total"))
    w = Window.partitionBy("view", "start").orderBy(F.desc("share"), "key")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("view", "start", "end", "rank", "key", (F.col("share") * F.col("duration")).alias("contribution"), "share")


def interpretation(score: DataFrame, parts: DataFrame, views: int = 3, keys: int = 3) -> DataFrame:
    """(rank, line): the views with the highest scores in words, with their main contributors."""
    best = score.orderBy(F.desc("overall_score"), "view").limit(views).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall_score"), "view")))
    text = F.concat(F.array_join("key", " | "), F.lit(" ("), F.format_string("%.4f", "contribution"), F.lit(")"))
    named = ranked(parts, keys).groupBy("view").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]), ", ").alias("names"))
    return best.join(named, "view", "left").select("rank", F.concat(F.col("view"), F.format_string(": overall %.4f, ", "overall_score"), hint(F.col("view")), F.coalesce(F.concat(F.lit("; mainly "), F.col("names")), F.lit(""))).alias("line"))


def top_intervals(line: DataFrame, most: int) -> DataFrame:
    """(view, rank, start, end, distance, contribution): the `most` intervals of a view that add most to its score; ties by start."""
    w = Window.partitionBy("view").orderBy(F.desc("contribution"), "start")
    each = line.withColumn("contribution", F.col("distance") * F.col("duration"))
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("view", "rank", "start", "end", "distance", "contribution")


def top_views(score: DataFrame, most: int) -> DataFrame:
    """(rank, view, overall_score): a row a view; ties by name."""
    return score.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall_score"), "view"))).filter(F.col("rank") <= most)  # at most eight rows


class Assessment(Mapping):
    """Tables by name, each made when it is first asked for; all of them read one sweep."""

    def __init__(self, **made: Callable[[], DataFrame]):
        self._made, self._found = made, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._found:
            self._found[name] = self._made[name]()
        return self._found[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


def assess(a: DataFrame, b: DataFrame, roles: DataFrame | None = None, views: list[str] | None = None, bounds: tuple | bool = False, case_mode: str = "interval", top: int = 5) -> Assessment:
    """The whole assessment of two logs, from raw rows: invalid ones are counted and left out, missing enable times are filled from the
    case, times are scaled to the bounds (given, or those of both logs where True) if wanted, and one sweep serves all views.

    meta: (log, valid, invalid); scores: (rank, view, overall_score); timeline; parts: contributors(); contributors: they ranked, all of them; intervals: the `top`
    contributors of every interval; text: the interpretation.
    """
    pair, meta, given = [], None, []
    for name, log in (("a", a), ("b", b)):
        events, invalid = normalise_events(log, roles=roles)
        counts = invalid.select(F.lit(name).alias("log"), (F.col("total") - F.col("invalid")).alias("valid"), "invalid")
        meta = counts if meta is None else meta.unionByName(counts)
        given.append(events)
        pair.append(fill_enable(events))
    if bounds:
        pair = list(normalise_times(*pair, *(bounds if isinstance(bounds, tuple) else ())))
    chosen = select_views(views, *pair, roles is not None, has_enable(*given))  # given times are a scan, filled ones a sort by case
    sweep = swept(*pair, chosen, roles is not None, case_mode)
    place = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("contribution"), "key"))
    found = Assessment(
        meta=lambda: meta,
        scores=lambda: top_views(swept_scores(sweep), len(VIEWS)),
        timeline=lambda: timeline(sweep),
        parts=lambda: contributors(sweep),
        contributors=lambda: found["parts"].withColumn("rank", place),
        intervals=lambda: interval_contributors(sweep, top),
        text=lambda: interpretation(swept_scores(sweep), found["parts"]),
    )
    return found
