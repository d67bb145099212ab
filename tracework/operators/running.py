"""Positions and running sums over an ordered axis without a window that runs in a single task.

Beyond ROWS_A_RANGE rows Spark's range partitioning cuts the axis: its bounds come from a sample of the order columns themselves,
whatever their type, and the number of ranges grows with the rows. The table is written with its ranges, each range is summed on
its own, and one small row per range says what came before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.sources.scratch import stored

#: A task sorts about so many rows.
ROWS_A_RANGE = 500_000
#: Most bins of a time axis by which stretches and points meet (each bound is one number on the driver).
MOST_RANGES = 4096
#: Buckets of keys that are counted first: where none has more rows than a range, no key has.
KEY_BUCKETS = 4096
#: Cells by which bounds are found, and up to how many of them are compared in a cell.
CELLS_A_BOUND, MOST_IN_A_CELL = 8, 4


def ranges(df: DataFrame, order: str, rows_a_range: int = ROWS_A_RANGE) -> list:
    """Bounds that bin a numeric axis into parts of about equally many rows, for joins of stretches with points."""
    n = df.count()
    k = max(1, min(MOST_RANGES, n // rows_a_range))
    if k == 1:
        return []
    got = df.agg(F.percentile_approx(order, [i / k for i in range(1, k)], 10 * k).alias("b")).first()["b"]
    return sorted(set(got))


def range_of(order: Column, found: list) -> Column:
    """The number of bounds at or below a value: a table of even cells has the bounds before a cell, those in it are compared. By halving where
    a cell has many bounds."""
    if not found:
        return F.lit(0)
    low, cells = float(found[0]), CELLS_A_BOUND * len(found)
    scale = cells / (float(found[-1]) - low) if found[-1] > low else 0.0
    at = [min(int((float(b) - low) * scale), cells - 1) for b in found]
    most = max(Counter(at).values())
    if most > MOST_IN_A_CELL:
        return range_within(order, F.lit(found), len(found))
    before = F.split(F.lit(",".join(str(bisect_left(at, c)) for c in range(cells))), ",").cast("array<int>")  # one literal
    bounds = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>" if isinstance(found[0], float) else "array<bigint>")
    cell = F.least(F.greatest(F.floor((order.cast("double") - F.lit(low)) * F.lit(scale)), F.lit(0)), F.lit(cells - 1)).cast("int")
    base = F.get(before, cell)
    return sum((F.when(F.get(bounds, base + k) <= order, 1).otherwise(0) for k in range(most)), F.coalesce(base, F.lit(0)))


def range_within(order: Column, array: Column, n: int) -> Column:
    """range_of() for n bounds in a column."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda acc, k: F.when(F.get(array, acc + k - 1) <= order, acc + k).otherwise(acc))


def cut(df: DataFrame, order: list[str], rows: int, rows_a_range: int) -> DataFrame:
    """df by ranges of the order columns, written, with _range and _at, the row's place in its range in that order."""
    k = -(-rows // rows_a_range)
    sorted_rows = df.repartitionByRange(k, *order).sortWithinPartitions(*order)
    # The id counts a partition's rows as they come, below bit 33.
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_at": at}))


def numbered(df: DataFrame, *order: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """df with n, its rows' positions from 0 by the order columns (of any type, nulls first), which must tell different rows apart."""
    rows = df.count()
    if rows <= rows_a_range:
        return df.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    df = cut(df, list(order), rows, rows_a_range)
    sizes = df.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row a range
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sizes.select("_range", before.alias("_before")), "_range").withColumn("n", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def running(df: DataFrame, keys: list[str], order: str, sums: list[str], rows_a_range: int = ROWS_A_RANGE, kept: bool = False, most: int | None = None) -> DataFrame:
    """df with run_<c>, the sum of c up to and with this row, for each of sums, and next_<order>.

    Rows must be unique by keys and order. df is written first, as it is counted and then summed; kept says that it is a written
    table already, and most, if known, how many rows a key has at most. Keys are dealt over tasks; only those with more rows than a range has are cut into ranges (split_sums).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    plain = lambda x: x.withColumns({f"run_{c}": F.sum(c).over(w) for c in sums} | {f"next_{order}": F.lead(order).over(w)})
    if most is not None and most <= rows_a_range:
        return plain(df)
    df = df if kept else stored(df)
    hot, rows = large_keys(df, keys, rows_a_range)
    if not rows:
        return plain(df)
    few, large = parted(df, keys, hot)
    found = split_sums(large, keys, order, sums, rows, rows_a_range)
    return found if few is None else plain(few).unionByName(found)


def large_keys(df: DataFrame, keys: list[str], rows_a_range: int = ROWS_A_RANGE) -> tuple[DataFrame | None, int]:
    """(keys with more rows than a range has, the number of their rows)."""
    if keys:
        buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        if (buckets.agg(F.max("_n").alias("n")).first()["n"] or 0) <= rows_a_range:
            return None, 0
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_a_range)
    hot = stored(counts) if keys else counts  # at most rows / rows_a_range of them
    return hot, hot.agg(F.sum("_n").alias("n")).first()["n"] or 0


def parted(df: DataFrame, keys: list[str], hot: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Rows of other keys and rows of hot keys; without keys all rows are hot."""
    if not keys:
        return None, df
    same = [df[k].eqNullSafe(hot[k]) for k in keys]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def earlier(df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, int]], rows_a_range: int = ROWS_A_RANGE, split: bool = True) -> DataFrame:
    """df with new columns, name to (column, k): that column k rows before, by the order columns, among rows of equal keys; null where there is none.

    Rows must be unique by keys and order. Keys with more rows than a range has are cut into ranges, each of which is given the last
    rows of those before it (its halo), as many as it may look back. split: whether there may be such keys.
    """
    w = lambda *more: Window.partitionBy(*more, *keys).orderBy(*order)
    seen = lambda x, *more: x.withColumns({name: F.lag(c, k).over(w(*more)) for name, (c, k) in wanted.items()})
    if not split:
        return seen(df)
    hot, rows = large_keys(df, keys, rows_a_range)
    if not rows:
        return seen(df)
    few, large = parted(df, keys, hot)
    large = cut(large, [*keys, *order], rows, rows_a_range)
    sizes = large.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row a range
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.withColumn("_start", before))
    back = max(k for _, k in wanted.values())
    last = large.join(sizes, "_range").filter(F.col("_at") >= F.col("_size") - back)
    begins = F.explode(F.sequence(F.col("_start") + F.col("_at") + 1, F.col("_start") + F.col("_at") + back))
    halo = last.withColumn("_begin", begins).drop("_range", "_size", "_start").join(sizes.select("_range", F.col("_start").alias("_begin")), "_begin")
    both = large.withColumn("_own", F.lit(True)).unionByName(halo.drop("_begin").withColumn("_own", F.lit(False)))
    found = seen(both, "_range").filter("_own").drop("_own", "_range", "_at")
    return found if few is None else seen(few).unionByName(found)


def split_sums(df: DataFrame, keys: list[str], order: str, sums: list[str], rows: int, rows_a_range: int) -> DataFrame:
    """running() by ranges along keys and order. A key has one row in each of its ranges, whose sums say what came before."""
    df = cut(df, [*keys, order], rows, rows_a_range).drop("_at")
    total = df.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums], F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_in"), *[F.sum(f"_t_{c}").over(before).alias(f"_b_{c}") for c in sums], F.lead("_first").over(w).alias("_after"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    out = df.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in sums} | {"_next": F.lead(order).over(inside)})
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(total, same)
    out = out.withColumns({f"run_{c}": F.col(f"_i_{c}") + F.coalesce(F.col(f"_b_{c}"), F.lit(0)) for c in sums} | {f"next_{order}": F.coalesce("_next", "_after")})
    return out.drop("_range", "_in", "_next", "_after", *[f"_k_{k}" for k in keys], *[f"_{p}_{c}" for p in "ib" for c in sums])
