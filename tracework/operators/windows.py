"""Filters and splits of logs by time. Which ends of an interval count is part of each operator; times are microseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.functions.scalar import SECOND, micros, moment
from tracework.log import InvalidLog, bounds, case_bounds
from tracework.operators.running import ROWS_A_RANGE, earlier, numbered
from tracework.sources.scratch import stored


def clipped(log: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Starts not before `start`, ends not after `end`; null times stay null."""
    out = {}
    if start is not None:
        out["start_time"] = F.when(F.col("start_time").isNotNull(), F.greatest("start_time", moment(start)))
    if end is not None:
        out["end_time"] = F.when(F.col("end_time").isNotNull(), F.least("end_time", moment(end)))
    return log.withColumns(out)


def trim_events(log: DataFrame, start: int, end: int) -> DataFrame:
    """Rows that touch [start, end], both ends closed, clipped to it."""
    return clipped(log.filter((F.col("end_time") >= moment(start)) & (F.col("start_time") <= moment(end))), start, end)


def dealt(log: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> Callable[[DataFrame], DataFrame]:
    """What deals the log, and tables of its cases, by case over tasks whose number grows with the log's rows, which are counted.

    Tables dealt alike are joined as they lie, and a task's share is about as large for any log.
    """
    k = max(1, -(-log.count() // rows_a_range))
    return lambda df: df.repartition(k, "case_id")


def with_case_bounds(log: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """log with _first and _last of each row's case: aggregate and join back, so that a huge case is no single task's window."""
    deal = dealt(log, rows_a_range)
    found = case_bounds(deal(log)).select(F.col("case_id").alias("_case"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    return deal(log).join(found.hint("shuffle_hash"), F.col("case_id") == F.col("_case")).drop("_case")


def split_cases(log: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(ongoing, complete): cases open at `start`, with what ends after it, unclipped; cases that begin in [start, end], whole."""
    known = with_case_bounds(log)
    ongoing = known.filter((F.col("_first") < start) & (F.col("_last") > start) & (micros("end_time") > start))
    complete = known.filter((F.col("_first") >= start) & (F.col("_first") <= end))
    return ongoing.drop("_first", "_last"), complete.drop("_first", "_last")


def split_into_subsets(log: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, ongoing, complete) of a window."""
    return trim_events(log, start, end), *split_cases(log, start, end)


def snapshot_labelled(log: DataFrame, partial_ids: DataFrame, cut: int, end: int, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Rows of a log resumed from a snapshot, with their subset, which is one a case; rows of other cases are left out.

    ongoing: cases of the snapshot or open at the cut by the log, all their rows, starts clipped up to the cut, so that a row
    that ended before it starts after its end. complete: other cases that begin in [cut, end).
    """
    deal = dealt(log, rows_a_range)
    own = log.select("case_id", micros("start_time").alias("first"), micros("end_time").alias("last"), F.lit(False).alias("partial"))
    given = partial_ids.select("case_id", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(True))
    known = deal(own.union(given)).groupBy("case_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bool_or("partial").alias("partial"))
    ongoing = F.col("partial") | ((F.col("first") < cut) & (F.col("last") > cut))
    subset = F.when(ongoing, "ongoing").when((F.col("first") >= cut) & (F.col("first") < end), "complete")
    cases = known.select("case_id", subset.alias("subset")).filter("subset IS NOT NULL")
    out = deal(log).join(cases.hint("shuffle_hash"), "case_id")
    clip = (F.col("subset") == "ongoing") & (F.col("start_time") < moment(cut))
    return out.withColumn("start_time", F.when(clip, moment(cut)).otherwise(F.col("start_time")))


def snapshot_subsets(log: DataFrame, partial_ids: DataFrame, cut: int, end: int, rows_a_range: int = ROWS_A_RANGE) -> tuple[DataFrame, DataFrame]:
    """(ongoing, complete) of snapshot_labelled()."""
    found = snapshot_labelled(log, partial_ids, cut, end, rows_a_range)
    ongoing, complete = (found.filter(F.col("subset") == k).drop("subset") for k in ("ongoing", "complete"))
    return ongoing, complete


def ongoing_case_ids(log: DataFrame, cut: int) -> DataFrame:
    """Cases with first < cut < last."""
    return case_bounds(log).filter((F.col("first") < cut) & (F.col("last") > cut)).select("case_id")


def cases_in_window(log: DataFrame, ids: DataFrame | None, cut: int, horizon: int) -> DataFrame:
    """Rows that overlap (cut, cut + horizon), open ends, of the given cases or of all, clipped."""
    out = log.filter((F.col("end_time") > moment(cut)) & (F.col("start_time") < moment(cut + horizon)))
    if ids is not None:
        out = out.join(ids.select("case_id").distinct(), "case_id", "left_semi")
    return clipped(out, cut, cut + horizon)


def prepare_snapshot(log: DataFrame, cut: int | None) -> DataFrame:
    """What was known at the cut: cases with anything after it, rows begun by then, later ends unknown. No cut: the log as it is."""
    if cut is None:
        return log
    later = (F.col("start_time") > moment(cut)) | F.col("end_time").isNull() | (F.col("end_time") > moment(cut))
    ids = log.groupBy("case_id").agg(F.bool_or(later).alias("l")).filter("l").select("case_id")
    out = log.join(ids, "case_id", "left_semi").filter(F.col("start_time") <= moment(cut))
    return out.withColumn("end_time", F.when(F.col("end_time") <= moment(cut), F.col("end_time")))


def split_train_test(log: DataFrame, train_fraction: float = 0.5, log_fraction: float = 1.0) -> tuple[DataFrame, DataFrame, int]:
    """(train, test, cut): whole cases by their first start, within the first part of the time span."""
    if not 0 < log_fraction <= 1 or not 0 < train_fraction < 1:
        raise ValueError("fractions must lie in (0, 1]")
    a, b = bounds(log)
    if b <= a:
        raise InvalidLog("the log has no span")
    used = a + int((b - a) * log_fraction)
    cut = a + int((used - a) * train_fraction)
    known = with_case_bounds(log).filter(F.col("_first") <= used)
    train, test = (known.filter(side).drop("_first", "_last") for side in (F.col("_first") <= cut, F.col("_first") > cut))
    if train.isEmpty() or test.isEmpty():
        raise InvalidLog("one side of the split is empty")
    return train, test, cut


def normalise_events(log: DataFrame, fields: dict[str, str] | None = None, roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, invalid count) for the mismatch assessment: mapped fields, invalid rows dropped and counted, enable times filled.

    Events: case_id, activity, resource, role, start, end, enable in seconds. A row without a time, or that ends by its start, is invalid.
    """
    names = {k: (fields or {}).get(k, k) for k in ("case_id", "activity", "resource", "start_time", "end_time", "enable_time")}

    def seconds(name: str) -> Column:
        if names[name] not in log.columns:
            return F.lit(None).cast("double")
        kind = dict(log.dtypes)[names[name]]
        c = F.col(names[name])
        return F.unix_micros(c) / SECOND if kind == "timestamp" else F.coalesce(c.cast("string").try_cast("double"), F.unix_micros(F.try_to_timestamp(c.cast("string"))) / SECOND)

    plain = lambda k: F.col(names[k]) if names[k] in log.columns else F.lit(None).cast("string")
    keep = [F.col("id")] if "id" in log.columns else []
    out = log.select(*keep, *[plain(k).alias(k) for k in ("case_id", "activity", "resource")], seconds("start_time").alias("start"), seconds("end_time").alias("end"), seconds("enable_time").alias("enable"))
    good = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    invalid = out.agg(F.count_if(~good).alias("invalid"), F.count(F.lit(1)).alias("total"))
    out = out.filter(good)
    out = out.join(roles, "resource", "left") if roles is not None else out.withColumn("role", F.lit(None).cast("string"))
    return out, invalid


def fill_enable(events: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Missing enable times: the end of the case's row before, by start and end; a very long case is looked through in ranges."""
    order = ["start", "end", *[c for c in ("id",) if c in events.columns]]
    return earlier(events, ["case_id"], order, {"_before": ("end", 1)}, rows_a_range).withColumn("enable", F.coalesce("enable", "_before")).drop("_before")


def normalise_times(a: DataFrame, b: DataFrame, start: float | None = None, end: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Both logs' times mapped so that [start, end] (or what both span) becomes [0, 1]; unchanged if that is no interval."""
    if start is None or end is None:
        got = a.select("start", "end").unionByName(b.select("start", "end")).agg(F.min("start").alias("s"), F.max("end").alias("e")).first()
        start, end = got["s"], got["e"]
    if start is None or end is None or end <= start:
        return a, b
    scaled = {c: (F.col(c) - start) / (end - start) for c in ("start", "end", "enable")}
    return a.withColumns(scaled), b.withColumns(scaled)


def candidate_cuts(log: DataFrame, horizon: int, source: str = "activity_end") -> DataFrame:
    """(t): distinct activity or case ends from half a horizon after the first start to a horizon before the last end."""
    a, b = bounds(log)
    low, high = a + horizon / 2, b - horizon
    if low >= high:
        raise InvalidLog("the log is too short for this horizon")
    if source not in ("activity_end", "case_end"):
        raise ValueError(f"unknown source {source!r}")
    ends = log.select(micros("end_time").alias("t")) if source == "activity_end" else case_bounds(log).select(F.col("last").alias("t"))
    return ends.filter((F.col("t") >= low) & (F.col("t") <= high)).distinct()


def subsample(cuts: DataFrame, most: int | None) -> DataFrame:
    """At most `most` of the cuts, equally spaced in their order, written: every feature reads them."""
    if not most or most <= 0:
        return cuts
    ranked = stored(numbered(cuts, "t"))
    n = ranked.count()
    at = sorted({int((n - 1) * k / (most - 1)) if most > 1 else 0 for k in range(most)})
    return stored((ranked.filter(F.col("n").isin(at)) if n > most else ranked).select("t"))
