"""How well a metric orders levels of perturbation. Rows: group columns, level, value; statistics per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.functions.scalar import fraction
from tracework.operators.running import ROWS_A_RANGE, running
from tracework.sources.scratch import stored

GROUP = ["scope", "family", "metric"]


def concordance(rows: DataFrame, keys: list[str], rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(keys, c_index): share of cross-level pairs in which the higher level has the higher value, ties one half.

    Inversions are counted as a merge sort of the levels counts them: levels have numbers, and two of them differ first in one binary
    digit, which is 0 for the lower one. For each digit, among values whose levels agree in all digits before it, running numbers
    along the values say how many of digit 0 lie below each of digit 1. n log(levels) rows; no pair of values is built.
    """
    rows = rows.filter("level IS NOT NULL AND value IS NOT NULL")
    counted = rows.groupBy(*keys, "level", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("level")) - 1
    levels = stored(rows.select(*keys, "level").distinct().withColumn("at", place))  # a row a level
    digits = max(1, int(levels.agg(F.max("at").alias("m")).first()["m"] or 0).bit_length())
    placed = counted.join(levels, [*keys, "level"])
    each = placed.withColumn("b", F.explode(F.array(*[F.lit(b) for b in range(digits)])))
    one = F.expr("shiftright(at, b)").bitwiseAND(F.lit(1)) == 1
    split = each.groupBy(*keys, "b", F.expr("shiftright(at, b + 1)").alias("same"), "value").agg(
        F.sum(F.when(one, 0).otherwise(F.col("n"))).alias("low"), F.sum(F.when(one, F.col("n")).otherwise(0)).alias("high")
    )
    line = running(split, [*keys, "b", "same"], "value", ["low"], rows_a_range)
    hits = F.col("high") * (F.col("run_low") - F.col("low") / 2)
    part = line.groupBy(*keys, "b", "same").agg(F.sum(hits).alias("hits"), (F.sum("low") * F.sum("high")).alias("pairs"))
    return part.groupBy(*keys).agg(F.try_divide(F.sum("hits"), F.sum("pairs")).alias("c_index")).filter("c_index IS NOT NULL")


def level_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "level").agg(F.avg("value").alias("mean"))


def spearman(means: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spearman): correlation of average ranks of level and mean; null for constant means."""
    w = lambda c: Window.partitionBy(*keys).orderBy(c)
    tie = F.count(F.lit(1)).over(Window.partitionBy(*keys, "mean"))
    ranked = means.withColumns({"x": F.rank().over(w("level")).cast("double"), "y": F.rank().over(w("mean")) + (tie - 1) / 2})
    return ranked.groupBy(*keys).agg(F.when(F.count_distinct("mean") > 1, F.corr("x", "y")).alias("spearman"))


def kendall(means: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kendall): tau-b of level and mean, over pairs of levels."""
    other = means.select(*keys, F.col("level").alias("l1"), F.col("mean").alias("m1"))
    pairs = means.join(other, keys).filter("l1 < level")
    return pairs.groupBy(*keys).agg(F.try_divide(F.sum(F.signum(F.col("mean") - F.col("m1"))), F.sqrt(F.count(F.lit(1)) * F.count_if(F.col("mean") != F.col("m1")))).alias("kendall"))


def point_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    means = level_means(rows, keys)
    return concordance(rows, keys).join(spearman(means, keys), keys).join(kendall(means, keys), keys)


def bootstrap(rows: DataFrame, keys: list[str], n_iter: int = 1000, alpha: float = 0.05, seed: str = "bootstrap") -> DataFrame:
    """(keys, <statistic>_ci_low, _ci_high): percentiles over resamples within levels, drawn by hash; undefined draws drop out."""
    at = Window.partitionBy(*keys, "level").orderBy("value")
    known = rows.select(*keys, "level", "value").withColumns({"k": F.row_number().over(at) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*keys, "level"))})
    tries = known.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(n_iter))))
    pick = F.floor(fraction(seed, F.concat_ws(":", *keys, "level", "k", "iteration")) * F.col("n")).cast("int")
    drawn = tries.select(*keys, "level", "iteration", pick.alias("k")).join(known.select(*keys, "level", "k", "value"), [*keys, "level", "k"])
    each = point_statistics(drawn, [*keys, "iteration"])
    stats = ("c_index", "spearman", "kendall")
    return each.groupBy(*keys).agg(*[F.percentile(s, F.lit(q)).alias(f"{s}_ci_{side}") for s in stats for side, q in (("low", alpha / 2), ("high", 1 - alpha / 2))])


def rankings(rows: DataFrame, n_bootstrap: int = 1000, alpha: float = 0.05, seed: str = "bootstrap") -> DataFrame:
    """All statistics per scope, family and metric with at least two levels; n_bootstrap 0 leaves the intervals out."""
    if missing := [c for c in (*GROUP, "level", "value") if c not in rows.columns]:
        raise ValueError(f"missing columns {missing}")
    clean = rows.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumns({"level": F.col("level").cast("int"), "value": F.col("value").cast("double")})
    size = clean.groupBy(*GROUP, "level").agg(F.count(F.lit(1)).alias("n")).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_levels"), F.min("n").alias("min_replicates_per_level")).filter("n_levels > 1")
    clean = clean.join(size.select(*GROUP), GROUP, "left_semi")
    out = size.join(point_statistics(clean, GROUP), GROUP)
    return out.join(bootstrap(clean, GROUP, n_bootstrap, alpha, seed), GROUP) if n_bootstrap else out
