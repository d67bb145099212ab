"""Choice of cut times and horizons. Work in process at t counts cases with first <= t < last; times are microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions.scalar import HOUR, fraction, moment
from tracework.log import InvalidLog, bounds, case_bounds
from tracework.operators.running import running
from tracework.operators.quantiles import quantiles
from tracework.operators.windows import numbered


def wip(log: DataFrame, arrivals_only: bool = False) -> DataFrame:
    """(t, wip) at every case boundary, or at arrivals alone; linear in the cases."""
    edges = case_bounds(log).select(F.explode(F.array(F.struct(F.col("first").alias("t"), F.lit(1).alias("d"), F.lit(1).alias("a")), F.struct(F.col("last").alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("a")))).alias("e"))
    steps = edges.groupBy(F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"), F.sum("e.a").alias("arrived"))
    out = running(steps, [], "t", ["d"])
    return (out.filter("arrived > 0") if arrivals_only else out).select("t", F.col("run_d").alias("wip"))


def fixed_cut(log: DataFrame, cut: int) -> DataFrame:
    """(t, wip): a given time as the cut, with the cases that are active there; none if it lies outside the log."""
    b = case_bounds(log)
    at = b.agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count_if((F.col("first") <= cut) & (F.col("last") > cut)).alias("wip"))
    return at.filter((F.col("a") <= cut) & (F.col("b") >= cut)).select(F.lit(cut).alias("t"), "wip")


def wip3(log: DataFrame) -> DataFrame:
    """(target, t): arrivals where work in process is 10, 50 and 90 % of its maximum: the first exact match, else the first above, else the first arrival."""
    series = wip(log, arrivals_only=True)
    most = series.agg(F.max("wip").alias("m"))
    targets = most.select(F.explode(F.array(*[F.bround(F.col("m") * q).cast("long") for q in (0.1, 0.5, 0.9)])).alias("target"))
    return series.crossJoin(F.broadcast(targets.distinct())).groupBy("target").agg(F.coalesce(F.min(F.when(F.col("wip") == F.col("target"), F.col("t"))), F.min(F.when(F.col("wip") > F.col("target"), F.col("t"))), F.min("t")).alias("t"))


def segment10(log: DataFrame, horizon: int, seed: str = "segment", segments: int = 10) -> DataFrame:
    """(segment, t): one seeded moment in each equal part of the log without a horizon at either end."""
    a, b = bounds(log)
    low, high = a + horizon, b - horizon
    if low >= high:
        raise InvalidLog("the log is shorter than two horizons")
    part = (high - low) / segments
    k = log.sparkSession.range(segments).select(F.col("id").cast("int").alias("segment"))
    return k.select("segment", F.floor(F.lit(low) + (F.col("segment") + fraction(seed, F.col("segment"))) * part).alias("t"))


def high_wip(log: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(t): the middle, by time, of the boundaries whose work in process reaches a quantile."""
    series = wip(log)
    least = quantiles(series, F.col("wip"), [quantile]).select(F.col("quantiles")[0].alias("q"))
    return middle(series.crossJoin(F.broadcast(least)).filter("wip >= q").select("t"))


def middle(times: DataFrame) -> DataFrame:
    """The element half way, by position, of distinct times."""
    n = times.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    return numbered(times, "t").crossJoin(F.broadcast(n)).filter("n = half").select("t")


def n_ongoing(log: DataFrame, target: int) -> DataFrame:
    """(t): the middle of the boundaries near a number of ongoing cases (20 %, at least 2); else the earliest of the nearest."""
    if target <= 0:
        raise ValueError("target must be positive")
    series, band = wip(log), max(2, int(0.2 * target))
    near = series.filter(F.abs(F.col("wip") - target) <= band).select("t")
    found = middle(near)
    nearest = series.agg(F.min(F.struct(F.abs(F.col("wip") - target), F.col("t")))["t"].alias("other"))
    return nearest.join(found, how="left").select(F.coalesce("t", "other").alias("t"))


def fraction_of_log(log: DataFrame, f: float = 0.5) -> int:
    """The time at a fraction of the span."""
    if not 0 < f < 1:
        raise ValueError("the fraction must lie in (0, 1)")
    a, b = bounds(log)
    return a + int((b - a) * f)


def adaptive_horizon(log: DataFrame, cut: int) -> int:
    """Twice the mean case duration, or what is left of the log."""
    mean = case_bounds(log).agg(F.avg(F.col("last") - F.col("first")).alias("m")).first()["m"]
    room = bounds(log)[1] - cut
    if room <= 0:
        raise InvalidLog("the cut is at or past the log's end")
    return min(int(2 * mean), room)


def fixed_horizon(log: DataFrame, cut: int, hours: float) -> int:
    """Some hours, or what is left of the log."""
    room = bounds(log)[1] - cut
    if room <= 0:
        raise InvalidLog("the cut is at or past the log's end")
    return min(int(hours * HOUR), room)


def warmup_shift(log: DataFrame, cut: int, ongoing: int) -> tuple[DataFrame, int]:
    """(log, shift): moved so that its first arrival, up to the cut, with that many active cases falls on the cut; unmoved without one."""
    got = wip(log, arrivals_only=True).filter((F.col("t") <= cut) & (F.col("wip") == ongoing)).agg(F.min("t").alias("t")).first()["t"]
    shift = 0 if got is None else cut - got
    if not shift:
        return log, 0
    return log.withColumns({c: moment(F.unix_micros(c) + shift) for c in ("enable_time", "start_time", "end_time") if c in log.columns}), shift
