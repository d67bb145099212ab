"""Error-interval models over cut samples (t, wip, features, target): groups of samples, each with a mean and an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.operators.aggregates import spread_ci
from tracework.operators.quantiles import quantiles
from tracework.operators.windows import numbered
from tracework.sources.scratch import stored

#: Method to the stem of its columns.
METHODS = {"baseline": "baseline", "wip_deciles": "wip_decile", "kmeans_simple": "kmeans_simple", "kmeans_advanced_wip": "kmeans_advanced_wip", "kmeans_statevec": "kmeans_statevec", "random_groups": "random_groups"}


def _groups(rows: DataFrame, group: Column, target: str) -> DataFrame:
    return rows.groupBy(group.alias("group_id")).agg(F.avg(target).alias("mean"), spread_ci(F.col(target)).alias("ci"), F.count(target).alias("count"))


def baseline(train: DataFrame, target: str) -> DataFrame:
    """(mean, ci, count, quantiles) over all samples."""
    found = quantiles(train, F.col(target), [0.05, 0.25, 0.5, 0.75, 0.95])
    return train.agg(F.avg(target).alias("mean"), spread_ci(F.col(target)).alias("ci"), F.count(target).alias("count")).crossJoin(F.broadcast(found))  # a row each


def random_groups(train: DataFrame, target: str, k: int = 3) -> DataFrame:
    """(group_id, mean, ci, count): samples with a target dealt in turn, by time."""
    known = train.filter(F.col(target).isNotNull())
    n = known.count()
    return _groups(known.join(numbered(known.select("t"), "t"), "t"), F.col("n") % max(1, min(k, n)), target)


def wip_edges(train: DataFrame, target: str, bins: int = 3) -> list[float]:
    """Quantile edges of wip, the first a little lower; bins + 1 numbers."""
    got = quantiles(train.filter(F.col(target).isNotNull()), F.col("wip"), [i / bins for i in range(bins + 1)]).first()["quantiles"]
    return [] if got is None else [got[0] - 1e-9, *got[1:]]


def wip_groups(train: DataFrame, target: str, edges: list[float]) -> DataFrame:
    """(group_id, mean, ci, count): bins open to the left, the last a little wider."""
    wip, last = F.col("wip"), len(edges) - 2
    bin_ = F.coalesce(*[F.when((wip > edges[i]) & (wip <= edges[i + 1] + (1e-9 if i == last else 0)), i) for i in range(last + 1)])
    return _groups(train.filter(F.col(target).isNotNull()).withColumn("_bin", bin_).filter("_bin IS NOT NULL"), F.col("_bin"), target)


def assign_wip(wip: Column, edges: list[float]) -> Column:
    """The bin of a value: edges at or below it, less one, within the bins. A value on an inner edge trains below and is assigned above."""
    at = sum((F.when(wip >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.when(wip.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), at)))


def points(rows: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(keep, x): rows whose features are all known, as whole millionths, so that sums are exact in any order."""
    x = F.array(*[F.round(F.col(c).cast("double") * 1e6).cast("long") for c in features])
    return rows.select(*dict.fromkeys((*keep, *features))).dropna().select(*keep, x.alias("x"))


def distances(x: Column, centres: list[list[float]]) -> Column:
    """Squared distances of a point to a few centres, in their order."""
    to = lambda c: F.aggregate(F.zip_with(x, F.lit([float(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return F.array(*[to(c) for c in centres])


def nearest(x: Column, centres: list[list[float]]) -> Column:
    """The number of the nearest centre, the first of several."""
    d = distances(x, centres)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def kmeans(train: DataFrame, features: list[str], target: str, k: int = 3) -> tuple[list[list[float]], DataFrame] | None:
    """(centres, groups) on rows without nulls, the same wherever it runs.

    The first centre is the earliest sample, each further one the sample farthest from those chosen (the earliest of several; none
    is added that lies on one). Then samples go to their nearest centre and centres to the mean of theirs, until none moves; a
    centre without samples stays. A round is one aggregation; k centres reach the driver.
    """
    rows = stored(points(train, features, "t", target))
    first = rows.agg(F.min_by("x", "t").alias("x")).first()["x"]
    if first is None:
        return None
    centres = [[float(v) for v in first]]
    while len(centres) < k:
        d = F.array_min(distances(F.col("x"), centres))
        far = rows.agg(F.max_by(F.struct("x", d.alias("d")), F.struct(d, -F.col("t"))).alias("far")).first()["far"]
        if far["d"] == 0:
            break
        centres.append([float(v) for v in far["x"]])
    seen = []
    while centres not in seen:
        seen = [*seen[-7:], centres]  # equal distances could make it turn in a small circle
        sums = [F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(len(features))]
        means = {r["g"]: [float(r[f"s{i}"]) / r["n"] for i in range(len(features))] for r in rows.groupBy(nearest(F.col("x"), centres).alias("g")).agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
        centres = [means.get(g, c) for g, c in enumerate(centres)]
    return centres, _groups(rows, nearest(F.col("x"), centres), target)


def assigned(test: DataFrame, centres: list[list[float]], features: list[str], name: str) -> DataFrame:
    """test with `name`, the nearest centre; null where a feature is."""
    at = points(test, features, "t").select("t", nearest(F.col("x"), centres).alias(name))
    return test.join(at, "t", "left")


def applied(test: DataFrame, groups: DataFrame, stem: str, group: Column | None, target: str) -> DataFrame:
    """test with <stem>_id, _mean, _ci and _in_ci; the model's rows are as many as its groups."""
    if group is None:
        one = groups.select(F.col("mean").alias(f"{stem}_mean"), F.col("ci").alias(f"{stem}_ci"))
        out = test.crossJoin(F.broadcast(one))
    else:
        few = groups.select(F.col("group_id").alias("_g"), F.col("mean").alias(f"{stem}_mean"), F.col("ci").alias(f"{stem}_ci"))
        out = test.withColumn(f"{stem}_id", group)
        out = out.join(F.broadcast(few), out[f"{stem}_id"] == few["_g"], "left").drop("_g")
    return out.withColumn(f"{stem}_in_ci", F.abs(F.col(target) - F.col(f"{stem}_mean")) <= F.col(f"{stem}_ci"))


def simple_methods(train: DataFrame, test: DataFrame, target: str, k: int = 3) -> DataFrame:
    """test with the predictions of the baseline, random groups and wip groups."""
    edges = wip_edges(train, target, k)
    out = applied(test, baseline(train, target), "baseline", None, target)
    n = train.filter(F.col(target).isNotNull()).count()
    out = applied(out.join(numbered(test.select("t"), "t"), "t"), random_groups(train, target, k), "random_groups", F.col("n") % max(1, min(k, n)), target).drop("n")
    return applied(out, wip_groups(train, target, edges), "wip_decile", assign_wip(F.col("wip"), edges), target)


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """The features of each clustering, out of a sample table's columns."""
    simple = ["wip", "arrival_rate_per_hour", "resource_availability"]
    starting = lambda *p: [c for c in columns if c.startswith(p)]
    return {"kmeans_simple": simple, "kmeans_advanced_wip": simple + starting("wip_enabled_", "wip_ongoing_"), "kmeans_statevec": starting("statevec_")}


def all_methods(train: DataFrame, test: DataFrame, target: str, k: int = 3) -> DataFrame:
    """test with the predictions of all six methods."""
    out = simple_methods(train, test, target, k)
    for stem, features in feature_sets(train.columns).items():
        if features and (got := kmeans(train, features, target, k)):
            out = assigned(out, got[0], features, f"{stem}_at")
            out = applied(out, got[1], stem, F.col(f"{stem}_at"), target).drop(f"{stem}_at")
    return out


def summarised(evaluation: DataFrame, error: str = "true_error", with_width: bool = False) -> DataFrame:
    """(method_key, n_points, coverage, avg_ci_width, avg_abs_error) over rows where the interval could be checked.

    with_width: rows without an interval width do not count either, and the error is averaged over all rows, as for training data.
    """
    have = [(k, s) for k, s in METHODS.items() if f"{s}_in_ci" in evaluation.columns]
    items = F.array(*[F.struct(F.lit(k).alias("method_key"), F.col(f"{s}_in_ci").alias("hit"), F.col(f"{s}_ci").alias("ci")) for k, s in have])
    rows = evaluation.select(F.col(error).alias("err"), F.explode(items).alias("m")).select("err", "m.*")
    ok = F.col("hit").isNotNull() & (F.col("ci").isNotNull() if with_width else F.lit(True))
    out = rows.groupBy("method_key").agg(
        F.count_if(ok).alias("n_points"), F.avg(F.when(ok, F.col("hit").cast("double"))).alias("coverage"), F.avg(F.when(ok, F.col("ci"))).alias("avg_ci_width"),
        F.avg(F.abs("err") if with_width else F.when(ok, F.abs("err"))).alias("avg_abs_error"),
    )
    return out.filter("n_points > 0")


def compared(summary: DataFrame) -> DataFrame:
    """summary with place: coverage down, width up, then by name."""
    return summary.withColumn("place", F.row_number().over(Window.orderBy(F.desc("coverage"), "avg_ci_width", "method_key")))  # six rows


def joined_samples(samples: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Samples beside their evaluation, by the cut's ISO time."""
    return samples.join(evaluation, "cut_time_iso")
