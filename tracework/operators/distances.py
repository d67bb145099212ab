"""Distances between histograms of two logs. Where a package defines a distance, the published definition is used and noted.

Earth mover's distances over bins of a line are areas between cumulative distributions: one running sum, no sample is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.functions.scalar import HOUR, micros
from tracework.log import case_bounds
from tracework.operators.running import ROWS_A_RANGE, earlier, running

#: Hours of a week, and of the week before the epoch's first hour, a Thursday.
WEEK, MONDAY = 168, 72


def counts(df: DataFrame, side: int, *keys: str) -> DataFrame:
    """(keys, bin, side, n) of a table with a column bin."""
    return df.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))


def wasserstein(hist: DataFrame, *keys: str) -> DataFrame:
    """(keys, distance, na, nb): first Wasserstein distance of weighted bins (bin, side, n); null if either side is empty."""
    sides = {f"n{x}": F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)) for k, x in enumerate("ab")}
    merged = hist.groupBy(*keys, "bin").agg(*[v.alias(k) for k, v in sides.items()])
    total = merged.groupBy(*keys).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    line = running(merged, list(keys), "bin", ["na", "nb"])
    line = line.join(total, list(keys)) if keys else line.crossJoin(F.broadcast(total))
    gap = F.abs(F.try_divide(F.col("run_na"), F.col("ta")) - F.try_divide(F.col("run_nb"), F.col("tb"))) * F.coalesce(F.col("next_bin") - F.col("bin"), F.lit(0))
    return line.groupBy(*keys).agg(F.when((F.max("ta") > 0) & (F.max("tb") > 0), F.sum(gap)).alias("distance"), F.max("ta").alias("na"), F.max("tb").alias("nb"))


def emd(hist: DataFrame) -> DataFrame:
    """(distance): unit moves between equally large samples: n times the Wasserstein distance [published definition]."""
    return wasserstein(hist).select((F.col("distance") * F.col("na")).alias("distance"))


def bin_of(c: Column, size: int) -> Column:
    return F.floor(c / size)


def remaining_time(a: DataFrame, b: DataFrame, reference: int, size: int = HOUR, normalise: bool = False) -> DataFrame:
    """(distance): remaining times of cases from a reference point, in bins; the smaller side is filled up with zeros.

    Empty on either side: null, as the panel of metrics has it. As both sides are equally large, this also is the moves over the cases.
    """
    hist = counts(case_bounds(a).select(bin_of(F.col("last") - reference, size).alias("bin")), 0).unionByName(counts(case_bounds(b).select(bin_of(F.col("last") - reference, size).alias("bin")), 1))
    n = hist.agg(*[F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).alias(x) for k, x in enumerate("ab")], F.max("bin").alias("most"))
    fill = n.select(F.lit(0).cast("long").alias("bin"), F.abs(F.col("a") - F.col("b")).alias("n"), F.when(F.col("a") < F.col("b"), 0).otherwise(1).alias("side")).filter("n > 0")
    found = wasserstein(hist.unionByName(fill)).crossJoin(F.broadcast(n))
    value = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("distance"))
    return found.select((F.when(F.col("most") > 0, value / F.greatest("most", F.lit(0))).otherwise(value) if normalise else value).alias("distance"))


def n_grams(log: DataFrame, n: int, rows_a_range: int = ROWS_A_RANGE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, gram): a case's activities by start, padded on both sides, in runs of n; a very long case is cut into ranges."""
    tie = [c for c in ("id",) if c in log.columns]
    order = ["kind", "start_time", "end_time", *tie, "pad"]
    pads = F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    whole = [*keys, "case_id"]
    cases = log.select(*whole).distinct()
    cols = [*whole, "activity", "start_time", "end_time", *tie]
    rows = log.select(*cols).withColumns({"kind": F.lit(1), "pad": F.lit(0)})
    for kind in (0, 2):
        pad = cases.withColumns({c: F.lit(None).cast(dict(log.dtypes)[c]) for c in cols if c not in whole} | {"kind": F.lit(kind)}).select("*", pads.alias("pad"))
        rows = rows.unionByName(pad)
    rows = rows.withColumns({"text": F.coalesce("activity", F.lit("\u0000")), "one": F.lit(1)})
    back = {f"t{k}": ("text", k) for k in range(n - 1, 0, -1)}
    found = earlier(rows, whole, order, back | {"w": ("one", n - 1)}, rows_a_range)
    return found.filter("w = 1").select(*keys, F.array(*back, "text").alias("gram"))


def n_gram_distance(a: DataFrame, b: DataFrame, n: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, distance): sum of |fa - fb| over sum of fa + fb, over n-grams [published definition]; null if either log is empty."""
    both = n_grams(a, n, keys=keys).withColumn("d", F.lit(1)).unionByName(n_grams(b, n, keys=keys).withColumn("d", F.lit(-1)))
    grams = both.groupBy(*keys, "gram").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("x"), F.count_if(F.col("d") < 0).alias("y"))
    return grams.groupBy(*keys).agg(F.when((F.sum("x") > 0) & (F.sum("y") > 0), F.sum(F.abs("d")) / F.sum("n")).alias("distance"))


def _pair(a: DataFrame, b: DataFrame, bins, *keys: str) -> DataFrame:
    return counts(bins(a), 0, *keys).unionByName(counts(bins(b), 1, *keys))


def absolute_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """(distance): starts by absolute hour [published definition]."""
    return wasserstein(_pair(a, b, lambda x: x.select(bin_of(micros("start_time"), HOUR).alias("bin")))).select("distance")


def circadian_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """(distance): starts by hour of day, the mean over the weekdays that both logs have [published definition]."""
    day = lambda x: x.select(F.weekday("start_time").alias("day"), F.hour("start_time").cast("long").alias("bin"))
    return wasserstein(_pair(a, b, day, "day"), "day").agg(F.avg("distance").alias("distance"))


def busy_hours(log: DataFrame) -> DataFrame:
    """(day, bin, n): in how many hours of the log, by weekday and hour of day, a resource was busy, summed over resources.

    An instance is busy from the hour of its start to that of its end. +1 and -1 along a resource's hours, summed, give stretches in
    which it is busy, each hour once. Whole weeks of a stretch count for all 168 hours of the week; what is left over begins and
    ends at an hour of the week, so that a stretch, however long, is at most four rows.
    """
    hours = log.filter("resource IS NOT NULL AND end_time >= start_time").select("resource", bin_of(micros("start_time"), HOUR).alias("a"), (bin_of(micros("end_time"), HOUR) + 1).alias("b"))
    both = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))
    edges = hours.select("resource", F.explode(both).alias("e")).groupBy("resource", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    busy = running(edges, ["resource"], "at", ["d"]).filter("run_d > 0").select((F.col("next_at") - F.col("at")).alias("len"), F.pmod(F.col("at") + MONDAY, F.lit(WEEK)).alias("h"))
    rest = F.col("len") % WEEK
    end = F.col("h") + rest
    step = lambda at, d: F.struct(at.cast("long").alias("at"), d.cast("long").alias("d"))
    over = F.when(end > WEEK, F.array(step(F.lit(0), F.lit(1)), step(end - WEEK, F.lit(-1)))).otherwise(F.array(step(end, F.lit(-1))))
    steps = F.flatten(F.array(F.array(step(F.lit(0), F.floor(F.col("len") / WEEK)), step(F.col("h"), F.lit(1))), over))
    found = busy.select(F.explode(steps).alias("e")).groupBy("e.at").agg(F.sum("e.d").alias("d"))
    # At most 169 rows; hours without a step of their own have what the hour before has.
    week = log.sparkSession.range(WEEK).select(F.col("id").alias("at")).join(F.broadcast(found), "at", "left")
    n = F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("at"))
    return week.select(F.floor(F.col("at") / 24).cast("int").alias("day"), (F.col("at") % 24).alias("bin"), n.alias("n")).filter("n > 0")


def circadian_workforce(a: DataFrame, b: DataFrame) -> DataFrame:
    """(distance): as circadian_events, over distinct busy resources in each hour [published definition]."""
    hist = busy_hours(a).withColumn("side", F.lit(0)).unionByName(busy_hours(b).withColumn("side", F.lit(1)))
    return wasserstein(hist, "day").agg(F.avg("distance").alias("distance"))


def _spans(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, case_id, first, last) in microseconds."""
    return log.groupBy(*keys, "case_id").agg(F.min(micros("start_time")).alias("first"), F.max(micros("end_time")).alias("last"))


def relative_events(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, distance): starts and ends by hours since the case began [published definition]."""

    def since(x: DataFrame) -> DataFrame:
        both = F.explode(F.array(micros("start_time"), micros("end_time")))
        return x.join(_spans(x, keys).drop("last"), [*keys, "case_id"]).select(*keys, "first", both.alias("t")).select(*keys, bin_of(F.col("t") - F.col("first"), HOUR).alias("bin"))

    return wasserstein(_pair(a, b, since, *keys), *keys).select(*keys, "distance")


def cycle_times(a: DataFrame, b: DataFrame, size: int = HOUR, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, distance): case durations in bins [published definition]."""
    return wasserstein(_pair(a, b, lambda x: _spans(x, keys).select(*keys, bin_of(F.col("last") - F.col("first"), size).alias("bin")), *keys), *keys).select(*keys, "distance")


def remaining_time_by(a: DataFrame, b: DataFrame, reference: int, keys: tuple[str, ...], size: int = HOUR) -> DataFrame:
    """(keys, distance): remaining_time() of each group."""
    hist = _pair(a, b, lambda x: _spans(x, keys).select(*keys, bin_of(F.col("last") - reference, size).alias("bin")), *keys)
    n = hist.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).alias(x) for k, x in enumerate("ab")])
    fill = n.select(*keys, F.lit(0).cast("long").alias("bin"), F.abs(F.col("a") - F.col("b")).alias("n"), F.when(F.col("a") < F.col("b"), 0).otherwise(1).alias("side")).filter("n > 0")
    found = wasserstein(hist.unionByName(fill), *keys).drop("na", "nb").join(n, list(keys))
    return found.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("distance")).alias("distance"))


def case_arrivals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(distance): first starts by absolute hour [published definition]."""
    return wasserstein(_pair(a, b, lambda x: case_bounds(x).select(bin_of(F.col("first"), HOUR).alias("bin")))).select("distance")
