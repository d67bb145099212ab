"""Work-in-progress features at many cuts in one pass. Cuts are a table (t) of microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions.scalar import HOUR, micros, safe_name
from tracework.log import case_bounds
from tracework.operators.running import range_of, ranges
from tracework.sources.scratch import stored


def environment(log: DataFrame) -> DataFrame:
    """(cases, resources, activities, has_enable_time): sizes of what features refer to."""
    enable = F.bool_or(F.col("enable_time").isNotNull()) if "enable_time" in log.columns else F.lit(False)
    kinds = log.agg(F.count_distinct("resource").alias("resources"), F.count_distinct("activity").alias("activities"), enable.alias("has_enable_time"))
    return case_bounds(log).agg(F.count(F.lit(1)).alias("cases")).crossJoin(F.broadcast(kinds))


def stabbed(spans: DataFrame, cuts: DataFrame, rows_a_range: int = 1) -> DataFrame:
    """Rows of spans (a, b, ...) beside every cut t with a <= t < b.

    The axis is cut into ranges, of a cut each up to MOST_RANGES, else of about equally many; spans are repeated for each range they
    touch and meet the cuts by an equal join, so that neither side needs to be small and a span is compared with the cuts near it alone.
    """
    cut = ranges(cuts, "t", rows_a_range)
    spans = spans.filter("a < b").withColumn("_r", F.explode(F.sequence(range_of(F.col("a"), cut), range_of(F.col("b"), cut))))
    return spans.join(cuts.select("t").withColumn("_r", range_of(F.col("t"), cut)), "_r").filter("a <= t AND t < b").drop("_r")


def _active(log: DataFrame, *extra: str) -> DataFrame:
    return log.select(*extra, micros("start_time").alias("a"), micros("end_time").alias("b"))


def _enabled(log: DataFrame, *extra: str) -> DataFrame:
    return log.filter("enable_time IS NOT NULL").select(*extra, micros("enable_time").alias("a"), micros("start_time").alias("b"))


def wip(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """(t, wip): distinct cases with an active row."""
    found = stabbed(_active(log, "case_id"), cuts).groupBy("t").agg(F.count_distinct("case_id").alias("wip"))
    return cuts.select("t").join(found, "t", "left").select("t", F.coalesce("wip", F.lit(0)).alias("wip"))


def arrival_rate(log: DataFrame, cuts: DataFrame, horizon: int) -> DataFrame:
    """(t, arrival_rate_per_hour): arrivals in (t - horizon, t]; 0 for no horizon."""
    if horizon <= 0:
        return cuts.select("t", F.lit(0.0).alias("arrival_rate_per_hour"))
    found = stabbed(case_bounds(log).select(F.col("first").alias("a"), (F.col("first") + horizon).alias("b")), cuts).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return cuts.select("t").join(found, "t", "left").select("t", (F.coalesce("n", F.lit(0)) / (horizon / HOUR)).alias("arrival_rate_per_hour"))


def availability(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """(t, resource_availability): share of resources without active work; null without resources."""
    total = log.agg(F.count_distinct("resource").alias("total"))
    busy = stabbed(_active(log, "resource"), cuts).groupBy("t").agg(F.count_distinct("resource").alias("busy"))
    return cuts.select("t").join(busy, "t", "left").crossJoin(F.broadcast(total)).select("t", F.try_divide(F.col("total") - F.coalesce("busy", F.lit(0)), F.col("total")).alias("resource_availability"))


def by_activity(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """(t, activity, wip_enabled, wip_ongoing, state): distinct cases and the state vector, for every activity and cut.

    State: half the age of the longest enabled row over the greatest age of all, or a half plus that of the longest ongoing one.
    """
    ongoing = stabbed(_active(log, "case_id", "activity"), cuts).select("t", "activity", "case_id", (F.col("t") - F.col("a")).alias("age"), F.lit("ongoing").alias("kind"))
    both = ongoing
    if "enable_time" in log.columns:
        both = both.unionByName(stabbed(_enabled(log, "case_id", "activity"), cuts).select("t", "activity", "case_id", (F.col("t") - F.col("a")).alias("age"), F.lit("enabled").alias("kind")))
    pick = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    each = both.groupBy("t", "activity").agg(F.count_distinct(pick("enabled", "case_id")).alias("wip_enabled"), F.count_distinct(pick("ongoing", "case_id")).alias("wip_ongoing"), F.max(pick("enabled", "age")).alias("e"), F.max(pick("ongoing", "age")).alias("o"))
    most = each.groupBy("t").agg(F.max(F.greatest("e", "o")).alias("most"))
    grid = cuts.select("t").crossJoin(log.select("activity").distinct())
    part = lambda c, base: F.coalesce(F.try_divide(F.lit(0.5) * F.col(c), F.col("most")) + base, F.lit(0.0))
    out = grid.join(each, ["t", "activity"], "left").join(most, "t", "left")
    return out.select("t", "activity", F.coalesce("wip_enabled", F.lit(0)).alias("wip_enabled"), F.coalesce("wip_ongoing", F.lit(0)).alias("wip_ongoing"), F.greatest(part("e", 0.0), part("o", 0.5)).alias("state"))


def samples(log: DataFrame, cuts: DataFrame, horizon: int, targets: DataFrame | None = None) -> DataFrame:
    """One row per cut with all features as columns: wip, rates, and wip_enabled_*, wip_ongoing_*, statevec_* by activity.

    targets: (t, …) errors at the cuts, as aggregates.error_targets() makes them; joined beside the features, null where missing.
    """
    acts = stored(by_activity(log, cuts).withColumn("activity", safe_name(F.col("activity"))))  # a row a cut and activity
    names = sorted(r["activity"] for r in acts.select("activity").distinct().collect())  # the columns to be: one name an activity
    wide = acts.groupBy("t").pivot("activity", names).agg(F.first("wip_enabled").alias("wip_enabled"), F.first("wip_ongoing").alias("wip_ongoing"), F.first("state").alias("statevec"))
    wide = wide.select("t", *[F.col(f"{n}_{k}").cast("double").alias(f"{k}_{n}") for k in ("wip_enabled", "wip_ongoing", "statevec") for n in names])
    out = wip(log, cuts).join(arrival_rate(log, cuts, horizon), "t").join(availability(log, cuts), "t").join(wide, "t")
    return out if targets is None else out.join(targets, "t", "left")

