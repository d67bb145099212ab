"""Rows of an experiment: every metric of a log pair, and pairs of replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.operators import distances as D
from tracework.operators.sweep import instances, state_distances, summary, timeline, views_for


def metric_rows(base: DataFrame, sim: DataFrame, level: int, k_baseline: int, k_sim: int, scope: str, window: tuple[int, int], roles: DataFrame | None = None) -> DataFrame:
    """(level, k_baseline, k_sim, scope, family, metric, value): cardinality once, each view's Jaccard distance, and the baselines.

    A baseline that cannot be computed, as one side is empty, is null; resources without a role have the role `unknown`.
    """
    state = state_distances(base, sim, roles=roles, window=window, missing_role="unknown")
    jaccard = state.filter("distance = 'jaccard'").select(F.lit("state").alias("family"), F.concat("view", F.lit(".jaccard")).alias("metric"), F.col("summary_distance").alias("value"))
    cardinality = state.filter("distance = 'cardinality' AND view = 'activity'").select(F.lit("state").alias("family"), F.lit("cardinality").alias("metric"), F.col("summary_distance").alias("value"))
    out = jaccard.unionByName(cardinality)
    for name, df in (("ngd_n2", D.n_gram_distance(base, sim, 2)), ("red", D.relative_events(base, sim)), ("cycle_time", D.cycle_times(base, sim)), ("rtd", D.remaining_time(base, sim, window[0]))):
        out = out.unionByName(df.select(F.lit("baseline").alias("family"), F.lit(name).alias("metric"), F.col("distance").alias("value")))
    head = {"level": level, "k_baseline": k_baseline, "k_sim": k_sim, "scope": scope}
    return out.select(*[F.lit(v).alias(k) for k, v in head.items()], "family", "metric", "value")


def paired(baselines: DataFrame, simulations: DataFrame, *keys: str) -> DataFrame:
    """Baseline and simulation of the same replicate k side by side: (keys, k, baseline, simulated)."""
    return baselines.select(*keys, "k", F.col("value").alias("baseline")).join(simulations.select(*keys, "k", F.col("value").alias("simulated")), [*keys, "k"])


def ladder(pairs: list[tuple[int, int, str, DataFrame, DataFrame]], window: tuple[int, int], roles: DataFrame | None = None, views: list[str] | None = None) -> DataFrame:
    """State metric rows (level, k_sim, scope, family, metric, value) of every step of a ladder: (level, replicate, scope, reference, altered log).

    The steps are one more part of the view's name, so that one sweep serves the whole ladder.
    """
    found = None
    for level, k, scope, base, new in pairs:
        chosen = views or views_for(base, new, roles=roles)
        part = instances(base, new, chosen, roles, "unknown").withColumn("view", F.concat(F.lit(f"{level}:{k}:{scope}:"), F.col("view")))
        found = part if found is None else found.unionByName(part)
    part = F.split("view", ":")
    return summary(timeline(found, whole=False), window).select(
        part[0].cast("int").alias("level"), part[1].cast("int").alias("k_sim"), part[2].alias("scope"), F.lit("state").alias("family"), F.concat(part[3], F.lit("."), F.col("distance")).alias("metric"), F.col("summary_distance").alias("value")
    )


def ladder_utilisation(logs: list[tuple[int, int, DataFrame]], roles: DataFrame, window: tuple[int, int]) -> DataFrame:
    """(level, k_sim, role, …): how busy each role is in each step's log, as aggregates.utilisation() has it."""
    from tracework.operators.aggregates import utilisation

    out = None
    for level, k, log in logs:
        part = utilisation(log, roles, *window).select(F.lit(level).alias("level"), F.lit(k).alias("k_sim"), "*")
        out = part if out is None else out.unionByName(part)
    return out
