"""Ladders: a log changed at several levels, each with replicates, and compared with what it was.

A ladder is one log: a row of the log stands once a step, with the step's level and k (its replicate) as columns, so that the plan
is the same for any number of steps. Draws are nested: an id has one rank for each replicate, by a hash of seed, replicate and id, and a
level takes the ids whose rank lies below its threshold. Both logs of a comparison are keyed by `group`, the text level:k:scope.

Each flow gives (base, altered); base without steps is the same for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.functions.scalar import HOUR, fraction, micros
from tracework.log import InvalidLog, case_bounds
from tracework.operators import distances as D
from tracework.operators.running import running
from tracework.operators.sweep import Sweep, spans, summary, timeline, views_for
from tracework.operators.transforms import shifted
from tracework.operators.windows import cases_in_window, ongoing_case_ids

Steps = list[tuple[float, int]]


def steps(levels: list[float], replicates: int) -> Steps:
    """All (level, k)."""
    return [(level, k) for level in levels for k in range(replicates)]


def each_step(log: DataFrame, all_steps: Steps) -> DataFrame:
    """log once a step, with columns level and k."""
    found = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(k).alias("k")) for v, k in all_steps]))
    return log.withColumn("_step", found).select(*log.columns, "_step.level", "_step.k")


def each_replicate(ids: DataFrame, all_steps: Steps) -> DataFrame:
    return ids.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted({k for _, k in all_steps})])))


def _lot(seed: Column | str, key: str) -> Column:
    """What a replicate's draw orders by."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.concat(F.md5(F.concat(seed, F.lit("-"), F.col("k").cast("string"), F.lit(":"), F.col(key).cast("string"))), F.lit(":"), F.col(key).cast("string"))


def ranked(rows: DataFrame, keys: list[str], order: str, name: str = "rank") -> DataFrame:
    """rows with their positions from 0 among rows of equal keys."""
    return running(rows.withColumn("_one", F.lit(1)), keys, order, ["_one"]).withColumn(name, F.col("run__one") - 1).drop("_one", "run__one", f"next_{order}")


def scoped(log: DataFrame, cut: int, horizon: int, names: str = "A", ids: DataFrame | None = None) -> DataFrame:
    """The log's rows in the window with their scope: A has the cases that are ongoing at the cut, B all of them."""
    out = None
    for name in names:
        own = (ongoing_case_ids(log, cut) if ids is None else ids) if name == "A" else None
        part = cases_in_window(log, own, cut, horizon).withColumn("scope", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def relabel(base: DataFrame, activity: str, to_label: str, all_steps: Steps, seed: str = "relabel") -> tuple[DataFrame, DataFrame]:
    """Of each scope, round(level % of n) instances of an activity get another label."""
    own = base.filter(F.col("activity") == activity).select("scope", "id")
    drawn = ranked(each_replicate(own, all_steps).withColumn("o", _lot(seed, "id")), ["scope", "k"], "o").select("scope", "k", "id", "rank")
    sizes = own.groupBy("scope").agg(F.count(F.lit(1)).alias("size"))  # a row a scope
    out = each_step(base, all_steps).join(drawn, ["scope", "k", "id"], "left").join(sizes, "scope", "left")
    hit = F.col("rank") < F.bround(F.col("level") / 100 * F.col("size"))
    return base, out.withColumn("activity", F.when(hit, to_label).otherwise(F.col("activity"))).drop("rank", "size")


def rephase(base: DataFrame, cut: int, end: int, all_steps: Steps, seed: str = "rephase") -> tuple[DataFrame, DataFrame]:
    """Cases that were cut to the window move by up to level hours to either side, no further than the window lets them."""
    bounds = each_step(case_bounds(base), all_steps)
    most = F.col("level") * HOUR
    lo, hi = F.least(most, F.greatest(F.col("first") - cut, F.lit(0))), F.least(most, F.greatest(F.lit(end) - F.col("last"), F.lit(0)))
    u = fraction(seed, F.concat_ws(":", "k", "case_id"))
    by = bounds.select("level", "k", "case_id", F.floor(u * (lo + hi) - lo).cast("long").alias("_by"))
    return base, shifted(each_step(base, all_steps).join(by, ["level", "k", "case_id"]), F.col("_by")).drop("_by")


def _tags(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.min_by("case_type", F.struct("start_time", "id")).alias("tag"), F.min(micros("start_time")).alias("first"))


def _retagged(base: DataFrame, new: DataFrame, all_steps: Steps) -> tuple[DataFrame, DataFrame]:
    """new: (level, k, case_id, new) of cases with another type."""
    out = each_step(base, all_steps).join(new.withColumn("_hit", F.lit(True)), ["level", "k", "case_id"], "left")
    return base, out.withColumn("case_type", F.when(F.col("_hit"), F.col("new")).otherwise(F.col("case_type"))).drop("_hit", "new")


def _below(rank: Column, of_level: dict[float, int]) -> Column:
    """The levels whose threshold a rank lies below."""
    found = F.array(*[F.when(rank < n, F.lit(float(v))) for v, n in sorted(of_level.items())])
    return F.explode(F.filter(found, lambda x: x.isNotNull()))


def swap(log: DataFrame, base: DataFrame, all_steps: Steps, seed: str = "swap") -> tuple[DataFrame, DataFrame]:
    """Of either type of the log's cases, floor(level % of the smaller number) change sides."""
    tags = _tags(log)
    sizes = {r["tag"]: r["n"] for r in tags.filter("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(sizes) != 2:
        raise InvalidLog("a swap needs exactly two case types")
    a, b = sorted(sizes)
    side = F.when(F.col("tag") == a, f"{seed}-a").otherwise(f"{seed}-b")
    known = each_replicate(tags.filter("tag IS NOT NULL"), all_steps).withColumn("o", _lot(side, "case_id"))
    taken = {v: int(v / 100 * min(sizes.values())) for v, _ in all_steps}
    drawn = ranked(known, ["tag", "k"], "o").withColumn("level", _below(F.col("rank"), taken))
    return _retagged(base, drawn.select("level", "k", "case_id", F.when(F.col("tag") == a, b).otherwise(a).alias("new")), all_steps)


def drift(log: DataFrame, base: DataFrame, all_steps: Steps, seed: str = "drift") -> tuple[DataFrame, DataFrame]:
    """Among round(level % of n) arrivals of the log the smallest type comes first."""
    tags = _tags(log)
    n = tags.count()
    taken = {v: m for v, _ in all_steps if (m := round(v / 100 * n)) > 1}
    none = base.sparkSession.createDataFrame([], "level double, k int, case_id string, new string")
    if not taken:
        return _retagged(base, none, all_steps)
    known = each_replicate(tags, all_steps).withColumn("o", _lot(seed, "case_id"))
    chosen = ranked(known, ["k"], "o").withColumn("level", _below(F.col("rank"), taken)).withColumn("arrival", F.struct("first", "case_id"))
    placed = ranked(chosen.select("level", "k", "case_id", "tag", "arrival"), ["level", "k"], "arrival", "place")
    least = placed.groupBy("level", "k").agg(F.min("tag").alias("early"), F.count_distinct("tag").alias("kinds")).filter("kinds > 1")
    placed = placed.join(least.drop("kinds"), ["level", "k"])
    is_early = F.coalesce(F.col("tag") == F.col("early"), F.lit(False))
    sizes = placed.groupBy("level", "k").agg(F.count_if(is_early).alias("n_early"))  # a row a step
    late = ranked(placed.filter(~is_early).select("level", "k", "tag", "place"), ["level", "k"], "place", "at").join(sizes, ["level", "k"])
    late = late.select("level", "k", (F.col("at") + F.col("n_early")).alias("place"), F.col("tag").alias("later"))
    new = placed.join(sizes, ["level", "k"]).join(late, ["level", "k", "place"], "left")
    new = new.select("level", "k", "case_id", F.when(F.col("place") < F.col("n_early"), F.col("early")).otherwise(F.col("later")).alias("new"))
    return _retagged(base, new, all_steps)


def mix(green: DataFrame, red: DataFrame, share: float, cases: int, cut: int, horizon: int, all_steps: Steps, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Logs of round((share + level %) cases) cases of one log and the rest of the other, against that at level 0 of the same replicate.

    Levels whose share leaves [0, 1] are left out; each log has its own cases that are ongoing at the cut.
    """
    all_steps = [(v, k) for v, k in all_steps if 0 <= share + v / 100 <= 1]
    wanted = {v: round((share + v / 100) * cases) for v in {v for v, _ in all_steps} | {0.0}}
    out = []
    for log, prefix, tag, of_level in ((green, "g_", "green", wanted), (red, "r_", "red", {v: cases - n for v, n in wanted.items()})):
        log = log.withColumn("case_id", F.concat(F.lit(prefix), F.col("case_id")))
        ids = log.select("case_id").distinct()
        if max(of_level.values()) > ids.count():
            raise InvalidLog(f"{tag}: {max(of_level.values())} cases wanted, fewer there")
        drawn = ranked(each_replicate(ids, all_steps).withColumn("o", _lot(f"{seed}-{tag}", "case_id")), ["k"], "o")
        kept = drawn.withColumn("level", _below(F.col("rank"), of_level)).select("level", "k", "case_id")
        out.append(scoped(log, cut, horizon).withColumn("case_type", F.lit(tag)).join(kept, "case_id"))
    both = out[0].unionByName(out[1])
    levels = F.explode(F.array(*[F.lit(float(v)) for v in sorted({v for v, _ in all_steps})]))
    base = both.filter("level = 0").withColumn("level", levels)
    return base, both.join(F.broadcast(base.sparkSession.createDataFrame([(float(v), k) for v, k in all_steps], "level double, k int")), ["level", "k"], "left_semi")


def rows(base: DataFrame, altered: DataFrame, all_steps: Steps, window: tuple[int, int], roles: DataFrame | None = None) -> DataFrame:
    """(level, k_baseline, k_sim, scope, family, metric, value): cardinality once, each view's Jaccard distance, and the baselines, of every step.

    One sweep serves all steps; each baseline is one histogram distance keyed by the step. A baseline that cannot be computed is null.
    """
    own = "level" in base.columns
    group = F.concat_ws(":", "level", "k", "scope")
    base = (base if own else each_step(base, all_steps)).withColumn("group", group)
    altered = altered.withColumn("group", group)
    found, names = spans(base, altered, views_for(base, altered, roles=roles), roles, "unknown", "group")
    state = summary(timeline(Sweep(found, keys=names, group="group"), whole=False), window).filter("distance = 'jaccard' OR view LIKE '%:activity'")
    name = F.substring_index("view", ":", -1)
    state = state.select(F.substring_index("view", ":", 3).alias("group"), F.lit("state").alias("family"), F.when(F.col("distance") == "jaccard", F.concat(name, F.lit(".jaccard"))).otherwise("cardinality").alias("metric"), F.col("summary_distance").alias("value"))
    keys = ("group",)
    baselines = {
        "ngd_n2": D.n_gram_distance(base, altered, 2, keys), "red": D.relative_events(base, altered, keys),
        "cycle_time": D.cycle_times(base, altered, keys=keys), "rtd": D.remaining_time_by(base, altered, window[0], keys),
    }
    out = state
    for metric, df in baselines.items():
        out = out.unionByName(df.select("group", F.lit("baseline").alias("family"), F.lit(metric).alias("metric"), F.col("distance").alias("value")))
    part = F.split("group", ":")
    k = part[1].cast("int")
    return out.select(part[0].cast("double").alias("level"), (k if own else F.lit(0)).alias("k_baseline"), k.alias("k_sim"), part[2].alias("scope"), "family", "metric", "value")
