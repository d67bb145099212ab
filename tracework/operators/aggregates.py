"""Aggregates over logs and over metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.functions.scalar import SECOND, micros
from tracework.log import case_bounds
from tracework.operators import distances as D
from tracework.operators.quantiles import quantiles


def avg_remaining_time(log: DataFrame, cut: int) -> DataFrame:
    """(avg_remaining): mean seconds from the cut to each case's last end; 0 for an empty log."""
    return case_bounds(log).agg(F.coalesce(F.avg(F.col("last") - cut) / SECOND, F.lit(0.0)).alias("avg_remaining"))


def remaining_difference(a: DataFrame, b: DataFrame, cut: int) -> DataFrame:
    """(value): relative difference of mean remaining times; null where the reference's is 0."""
    x, y = avg_remaining_time(a, cut).select(F.col("avg_remaining").alias("x")), avg_remaining_time(b, cut).select(F.col("avg_remaining").alias("y"))
    return x.crossJoin(F.broadcast(y)).select(F.when(F.col("x") != 0, F.abs(F.col("x") - F.col("y")) / F.col("x")).alias("value"))


def case_counts(log: DataFrame) -> DataFrame:
    """(cases, events, events_per_case), the last null for an empty log. Cases are counted by groups, not by one distinct set."""
    return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("events")).withColumn("events_per_case", F.try_divide(F.col("events"), F.col("cases")))


def case_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cases_diff, events_per_case_diff)."""
    x = case_counts(a)
    y = case_counts(b).select(F.col("cases").alias("c"), F.col("events_per_case").alias("e"))
    return x.crossJoin(F.broadcast(y)).select(F.abs(F.col("cases") - F.col("c")).alias("cases_diff"), F.abs(F.col("events_per_case") - F.col("e")).alias("events_per_case_diff"))


def last_arrival(log: DataFrame) -> DataFrame:
    """(last_case_arrival) in microseconds."""
    return case_bounds(log).agg(F.max("first").alias("last_case_arrival"))


def utilisation(log: DataFrame, roles: DataFrame, cut: int, end: int) -> DataFrame:
    """(role, n_resources, busy_seconds, window_seconds, utilization): time worked in [cut, end] over time there; every role, idle ones 0."""
    sizes = roles.groupBy("role").agg(F.count(F.lit(1)).alias("n_resources"))
    if end <= cut:
        return sizes.select("role", "n_resources", *[F.lit(None).cast("double").alias(c) for c in ("busy_seconds", "window_seconds", "utilization")]).limit(0)
    spent = (F.least(micros("end_time"), F.lit(end)) - F.greatest(micros("start_time"), F.lit(cut))) / SECOND
    live = log.filter((micros("end_time") > cut) & (micros("start_time") < end))
    busy = live.select("resource", spent.alias("d")).groupBy("resource").agg(F.sum("d").alias("d")).join(roles, "resource").groupBy("role").agg(F.sum("d").alias("busy_seconds"))
    out = sizes.join(busy, "role", "left").withColumn("busy_seconds", F.coalesce("busy_seconds", F.lit(0.0)))
    window = (end - cut) / SECOND
    return out.select("role", "n_resources", "busy_seconds", F.lit(window).alias("window_seconds"), F.try_divide(F.col("busy_seconds"), F.col("n_resources") * window).alias("utilization"))


def target_activity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(activity): the most frequent of scope a among those that b has too, else the most frequent of b; ties by name."""
    x = a.groupBy("activity").agg(F.count(F.lit(1)).alias("na"))
    y = b.groupBy("activity").agg(F.count(F.lit(1)).alias("nb"))
    both = y.join(x, "activity", "left")
    best = both.agg(F.min(F.when(F.col("na").isNotNull(), F.struct((-F.col("na")).alias("o"), F.col("activity").alias("activity")))).alias("p"), F.min(F.struct((-F.col("nb")).alias("o"), F.col("activity").alias("activity"))).alias("q"))
    return best.select(F.coalesce("p.activity", "q.activity").alias("activity"))


def duration_percentile(log: DataFrame, p: float = 0.95) -> DataFrame:
    """(horizon_seconds): a percentile of case durations, interpolated, at least a second."""
    found = quantiles(case_bounds(log), (F.col("last") - F.col("first")) / SECOND, [p])
    return found.select(F.greatest(F.col("quantiles")[0], F.lit(1.0)).alias("horizon_seconds"))


def mean_and_ci(value: Column) -> tuple[Column, Column]:
    """Mean and half width of its 95 % interval, 1.96 sd / sqrt(n); the width is null for fewer than two values."""
    return F.avg(value), 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))


def spread_ci(value: Column) -> Column:
    """Half width of a predictive interval: 1.96 sd, 0 for a single value, null for none."""
    return F.when(F.count(value) == 1, 0.0).otherwise(1.96 * F.stddev_samp(value))


def aggregate_runs(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean, ci) over the runs of each metric; null values do not count."""
    mean, ci = mean_and_ci(F.col("value"))
    return rows.groupBy(*keys).agg(mean.alias("mean"), ci.alias("ci"))


def aggregate_cuts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean): mean of the cuts' means."""
    return rows.groupBy(*keys).agg(F.avg("mean").alias("mean"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("A", "B")) -> DataFrame:
    """(keys, winner): the side with the lower mean, `tie`, or null where a mean is missing."""
    x, y = a.select(*keys, F.col("mean").alias("x")), b.select(*keys, F.col("mean").alias("y"))
    who = F.when(F.col("x").isNull() | F.col("y").isNull(), None).when(F.col("x") < F.col("y"), names[0]).when(F.col("x") > F.col("y"), names[1]).otherwise("tie")
    return x.join(y, keys, "full").select(*keys, who.alias("winner"))


def error_targets(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, err_RTD_mean, err_RTD_ci, err_cycle_mean, err_cycle_ci) out of metric rows."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return rows.groupBy(*keys).agg(pick("RTD", "mean").alias("err_RTD_mean"), pick("RTD", "ci").alias("err_RTD_ci"), pick("cycle_time", "mean").alias("err_cycle_mean"), pick("cycle_time", "ci").alias("err_cycle_ci"))


def metric_panel(a: tuple[DataFrame, DataFrame, DataFrame], b: tuple[DataFrame, DataFrame, DataFrame], cut: int) -> DataFrame:
    """(subfamily, metric, value) over (events, ongoing, complete) subsets of two logs; null where a side is empty."""
    (ae, ao, ac), (be, bo, bc) = a, b
    one = lambda family, name, df, c="distance": df.select(F.lit(family).alias("subfamily"), F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
    diff = case_differences(ao, bo)
    parts = [
        one("event_filter", "n_gram", D.n_gram_distance(ae, be, 3)), one("event_filter", "absolute_event", D.absolute_events(ae, be)),
        one("event_filter", "circadian_event", D.circadian_events(ae, be)), one("event_filter", "circadian_workflow", D.circadian_workforce(ae, be)),
        one("ongoing_filter", "RTD", D.remaining_time(ao, bo, cut)), one("ongoing_filter", "avg_remaining_diff", remaining_difference(ao, bo, cut), "value"),
        one("ongoing_filter", "ongoing_cases_count", case_counts(bo), "cases"), one("ongoing_filter", "ongoing_cases_count_diff", diff, "cases_diff"),
        one("ongoing_filter", "avg_events_per_case", case_counts(bo), "events_per_case"), one("ongoing_filter", "avg_events_per_case_diff", diff, "events_per_case_diff"),
        one("complete_filter", "RED", D.relative_events(ac, bc)), one("complete_filter", "cycle_time", D.cycle_times(ac, bc)), one("complete_filter", "case_arrival_rate", D.case_arrivals(ac, bc)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
