"""Exact quantiles by rank, over any number of different values: no buffer holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.operators.running import ROWS_A_RANGE, running


def quantiles(rows: DataFrame, value: Column, qs: list[float], keys: list[str] | None = None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(keys, quantiles): an array in the order of qs, interpolated between neighbouring values; null values do not count.

    Equal values are one row with their number. Running numbers along the values, over ranges where they are many, say which rows
    hold the wanted ranks: one or two a quantile. Without keys and values the row has nulls.
    """
    keys = keys or []
    counted = rows.select(*keys, value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    line = running(counted, keys, "v", ["n"], rows_a_range)
    total = line.groupBy(*keys).agg(F.sum("n").alias("total"))
    line = line.join(total, keys) if keys else line.crossJoin(F.broadcast(total))  # a row
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for k, q in enumerate(qs)])
    inside = F.filter(wanted, lambda x: (F.floor(x["at"]) >= F.col("run_n") - F.col("n")) & (F.floor(x["at"]) < F.col("run_n")))
    held = line.withColumn("w", F.explode(inside))
    part = F.col("w.at") - F.floor("w.at")
    after = F.when((F.floor("w.at") + 1 < F.col("run_n")) | (part == 0), F.col("v")).otherwise(F.col("next_v"))
    found = held.select(*keys, F.struct("w.k", (F.col("v") + part * (after - F.col("v"))).alias("v")).alias("x"))
    out = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("quantiles"))  # as many as qs
    return out.withColumn("quantiles", F.when(F.size("quantiles") > 0, F.col("quantiles")))
