"""Controlled changes of a log, whose effect on each metric is known. Draws order by a hash of seed and id: repeatable anywhere.

Rows that a draw must not touch are left as they are; a change of strength 0 is the identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.functions.scalar import SECOND, fraction, lot, micros, moment
from tracework.log import InvalidLog, case_bounds
from tracework.operators.running import ROWS_A_RANGE, earlier, large_keys, running
from tracework.operators.windows import numbered


def drawn(ids: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """(key): n of the distinct ids, those with the least hash; ties cannot be, as the id ends the order."""
    order = ids.select(key).distinct().withColumn("_o", F.concat(lot(seed, F.col(key)), F.lit(":"), F.col(key).cast("string")))
    return numbered(order, "_o").filter(F.col("n") < n).select(key)


def relabel_fraction(log: DataFrame, activity: str, to_label: str, share: float, seed: str = "relabel") -> DataFrame:
    """Exactly round(share * n) instances of an activity get another label."""
    if not 0 <= share <= 1:
        raise ValueError("the share must lie in [0, 1]")
    own = log.filter(F.col("activity") == activity).select("id")
    chosen = drawn(own, "id", seed, round(share * own.count())).withColumn("_hit", F.lit(True))
    return log.join(chosen, "id", "left").withColumn("activity", F.when(F.col("_hit"), to_label).otherwise(F.col("activity"))).drop("_hit")


def rephase_cases(log: DataFrame, jitter_hours: float, cut: int, end: int, seed: str = "rephase") -> DataFrame:
    """One offset per case, uniform up to the jitter on either side, no further than the window lets it."""
    if jitter_hours <= 0:
        return log
    j = int(jitter_hours * 3600 * SECOND)
    room = case_bounds(log).select(F.col("case_id").alias("_c"), F.least(F.lit(j), F.greatest(F.col("first") - cut, F.lit(0))).alias("lo"), F.least(F.lit(j), F.greatest(F.lit(end) - F.col("last"), F.lit(0))).alias("hi"))
    offset = room.select("_c", F.floor(fraction(seed, F.col("_c")) * (F.col("lo") + F.col("hi")) - F.col("lo")).alias("_by"))
    return shifted(log.join(offset, F.col("case_id") == F.col("_c")), F.col("_by")).drop("_c", "_by")


def shifted(log: DataFrame, by: Column) -> DataFrame:
    return log.withColumns({c: moment(micros(c) + by) for c in ("start_time", "end_time", "enable_time") if c in log.columns})


def merge_at_ratio(green: DataFrame, red: DataFrame, share: float, cases: int, seed: str = "mix") -> DataFrame:
    """round(share * cases) cases of one log and the rest of the other, with prefixed ids and the side as case_type."""
    n = round(share * cases)
    out = []
    for log, prefix, tag, k in ((green, "g_", "green", n), (red, "r_", "red", cases - n)):
        log = log.withColumn("case_id", F.concat(F.lit(prefix), F.col("case_id")))
        ids = log.select("case_id").distinct()
        if k > ids.count():
            raise InvalidLog(f"{tag}: {k} cases wanted, fewer there")
        out.append(log.join(drawn(ids, "case_id", f"{seed}-{tag}", k), "case_id", "left_semi").withColumn("case_type", F.lit(tag)))
    return out[0].unionByName(out[1])


def _case_tags(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.min_by("case_type", F.struct("start_time", "id")).alias("tag"), F.min(micros("start_time")).alias("first"))


def swap_case_types(log: DataFrame, share: float, seed: str = "swap") -> DataFrame:
    """As many cases of either type, floor(share * the smaller number), change sides; numbers stay as they are."""
    if share <= 0:
        return log
    if share > 1:
        raise ValueError("the share must lie in [0, 1]")
    tags = _case_tags(log)
    sizes = {r["tag"]: r["n"] for r in tags.filter("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(sizes) != 2:
        raise InvalidLog("a swap needs exactly two case types")
    (a, na), (b, nb) = sorted(sizes.items())
    n = int(share * min(na, nb))
    chosen = drawn(tags.filter(F.col("tag") == a), "case_id", f"{seed}-a", n).union(drawn(tags.filter(F.col("tag") == b), "case_id", f"{seed}-b", n)).withColumn("_hit", F.lit(True))
    other = F.when(F.col("case_type") == a, b).otherwise(a)
    return log.join(chosen, "case_id", "left").withColumn("case_type", F.when(F.col("_hit"), other).otherwise(F.col("case_type"))).drop("_hit")


def drift_case_types(log: DataFrame, strength: float, seed: str = "drift") -> DataFrame:
    """Among round(strength * n) arrivals the smallest type comes first; numbers stay as they are."""
    if not 0 <= strength <= 1:
        raise ValueError("the strength must lie in [0, 1]")
    tags = _case_tags(log)
    k = round(strength * tags.count())
    if k <= 1:
        return log
    chosen = drawn(tags, "case_id", seed, k)
    # Positions are made unique by the case, and counted along a split axis.
    order = F.concat(F.lpad(F.col("first").cast("string"), 20, "0"), F.lit(":"), F.col("case_id"))
    placed = numbered(tags.join(chosen, "case_id", "left_semi").withColumn("_o", order), "_o").select("case_id", "tag", F.col("n").alias("pos"))
    least = placed.agg(F.min("tag").alias("early"), F.count_distinct("tag").alias("kinds")).first()
    if least["kinds"] < 2:
        return log
    early = F.coalesce(F.col("tag") == least["early"], F.lit(False))
    n_early = placed.filter(early).count()
    late = numbered(placed.filter(~early).select("pos", "tag"), "pos").select((F.col("n") + n_early).alias("rank"), F.col("tag").alias("new"))
    ranked = numbered(placed.select("case_id", "pos"), "pos").select("case_id", F.col("n").alias("rank"))
    new = ranked.join(late, "rank", "left").select("case_id", F.when(F.col("rank") < n_early, least["early"]).otherwise(F.col("new")).alias("_new"), F.lit(True).alias("_hit"))
    return log.join(new, "case_id", "left").withColumn("case_type", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("case_type"))).drop("_new", "_hit")


def _duration(log: DataFrame) -> Column:
    return micros("end_time") - micros("start_time")


def scale_durations(log: DataFrame, factor: float) -> DataFrame:
    """Every duration times a positive factor; starts stay."""
    if factor <= 0:
        raise ValueError("the factor must be positive")
    return log.withColumn("end_time", moment(micros("start_time") + F.floor(_duration(log) * factor)))


def swap_roles(log: DataFrame, roles: DataFrame, from_role: str, to_role: str, n_activities: int) -> DataFrame:
    """The first n activities, by name, that only one role does are given to the other's resources in turn."""
    if from_role == to_role or roles.filter(F.col("role").isin(from_role, to_role)).select("role").distinct().count() != 2:
        raise InvalidLog("two different known roles are needed")
    done = log.join(roles, "resource").groupBy("activity").agg(F.min("role").alias("a"), F.max("role").alias("b")).filter((F.col("a") == from_role) & (F.col("b") == from_role))
    chosen = done.select("activity").orderBy("activity").limit(n_activities)
    if chosen.count() < n_activities:
        raise InvalidLog("not enough activities of that role alone")
    target = numbered(roles.filter(F.col("role") == to_role).select("resource").distinct().withColumnRenamed("resource", "_new"), "_new")
    size = target.count()
    hit = log.join(chosen.withColumn("_hit", F.lit(True)), "activity", "left").withColumn("_k", F.pmod(F.col("id"), F.lit(size)))
    return hit.join(target, hit["_k"] == target["n"], "left").withColumn("resource", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("resource"))).drop("_hit", "_k", "_new", "n")


def shift_clock(log: DataFrame, hours: float, roles: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """All rows, or those of one role, some hours later."""
    by = F.lit(int(hours * 3600 * SECOND))
    if role is None:
        return shifted(log, by)
    own = roles.filter(F.col("role") == role).select("resource").distinct().withColumn("_hit", F.lit(True))
    return shifted(log.join(own, "resource", "left"), F.when(F.col("_hit"), by).otherwise(0)).drop("_hit")


def automate(log: DataFrame, activities: list[str], level: float, floor_seconds: float = 1.0) -> DataFrame:
    """The named activities take (100 - level) % of their time, at least a floor."""
    if not 0 <= level <= 100:
        raise ValueError("the level must lie in [0, 100]")
    found = {r["activity"] for r in log.filter(F.col("activity").isin(activities)).select("activity").distinct().collect()}
    if missing := set(activities) - found:
        raise InvalidLog(f"unknown activities {sorted(missing)}")
    if level == 0:
        return log
    new = F.greatest(F.floor(_duration(log) * (1 - level / 100)), F.lit(int(floor_seconds * SECOND)))
    return log.withColumn("end_time", F.when(F.col("activity").isin(activities), moment(micros("start_time") + new)).otherwise(F.col("end_time")))


def _along(log: DataFrame, sums: list[str], rows_a_range: int, split: bool) -> DataFrame:
    """log with run_<c> along each case, in its order (start, end, id); with split, very long cases are summed in ranges."""
    if not split:
        order = Window.partitionBy("case_id").orderBy("start_time", "end_time", "id")
        return log.withColumns({f"run_{c}": F.sum(c).over(order) for c in sums})
    return running(log.withColumn("_ord", F.struct("start_time", "end_time", "id")), ["case_id"], "_ord", sums, rows_a_range).drop("_ord", "next__ord")


def relaid(log: DataFrame, length: Column, rows_a_range: int = ROWS_A_RANGE, split: bool | None = None) -> DataFrame:
    """Each case laid out anew with other lengths (microseconds), in its order, the gaps between starts and earlier ends kept."""
    split = large_keys(log, ["case_id"], rows_a_range)[1] > 0 if split is None else split
    out = log.withColumn("_new", length).withColumn("_by", F.col("_new") - _duration(log))
    out = _along(out, ["_by"], rows_a_range, split)
    out = out.withColumn("_start", micros("start_time") + F.col("run__by") - F.col("_by"))
    return out.withColumns({"start_time": moment(F.col("_start")), "end_time": moment(F.col("_start") + F.col("_new"))}).drop("_new", "_by", "run__by", "_start")


def front_back_load(log: DataFrame, strength: float, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Weights 1 + s (1 - 2 i / (n - 1)) along each case, scaled so that its working time stays what it was."""
    if not -1 < strength < 1:
        raise ValueError("the strength must lie in (-1, 1)")
    if strength == 0:
        return log
    split = large_keys(log, ["case_id"], rows_a_range)[1] > 0
    out = _along(log.withColumns({"_one": F.lit(1), "_d": _duration(log)}), ["_one"], rows_a_range, split)
    out = _with_totals(out, {"_n": F.count(F.lit(1)), "_all": F.sum("_d")})
    weight = F.when(F.col("_n") > 1, 1 + strength * (1 - 2 * (F.col("run__one") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))).otherwise(1.0)
    out = _along(out.withColumn("_w", F.col("_d") * weight), ["_w"], rows_a_range, split)
    out = _with_totals(out, {"_ws": F.sum("_w")})
    share = F.col("run__w") * F.try_divide(F.col("_all"), F.col("_ws"))
    out = out.withColumn("_c", F.round(F.coalesce(share, F.lit(0.0))).cast("long"))
    out = earlier(out, ["case_id"], ["start_time", "end_time", "id"], {"_b": ("_c", 1)}, rows_a_range, split)
    out = out.withColumn("_len", F.when(F.col("_n") > 1, F.col("_c") - F.coalesce("_b", F.lit(0))).otherwise(F.col("_d")))
    return relaid(out, F.col("_len"), rows_a_range, split).drop("_one", "run__one", "_n", "_all", "_d", "_w", "run__w", "_ws", "_c", "_b", "_len")


def _with_totals(log: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """log with aggregates of each row's case: joined back, so that a huge case is no single window."""
    found = log.groupBy(F.col("case_id").alias("_case")).agg(*[v.alias(k) for k, v in totals.items()])
    return log.join(found, F.col("case_id").eqNullSafe(F.col("_case"))).drop("_case")


def swap_profiles(log: DataFrame, front: list[str], back: list[str], level: float) -> DataFrame:
    """Mean durations of two ordered lists of activities move towards each other's, position by position, by level percent."""
    if len(front) != len(back) or len(front) < 2 or not 0 <= level <= 100:
        raise ValueError("two lists of one length of at least two, and a level in [0, 100], are needed")
    named = log.sparkSession.createDataFrame([(p, q) for a, b in ((front, back), (back, front)) for p, q in zip(a, b, strict=True)], "activity string, other string")
    mean = log.filter(F.col("activity").isin(front + back)).groupBy("activity").agg(F.avg(_duration(log)).alias("mean"))
    if mean.count() != len(set(front + back)):
        raise InvalidLog("unknown activities")
    both = named.join(mean, "activity").join(mean.select(F.col("activity").alias("other"), F.col("mean").alias("theirs")), "other")
    factor = both.select(F.col("activity").alias("_a"), F.when(F.col("mean") > 0, ((1 - level / 100) * F.col("mean") + level / 100 * F.col("theirs")) / F.col("mean")).otherwise(1.0).alias("_f"))
    out = log.join(F.broadcast(factor), F.col("activity") == F.col("_a"), "left")
    return relaid(out, F.floor(_duration(log) * F.coalesce("_f", F.lit(1.0)))).drop("_a", "_f")
