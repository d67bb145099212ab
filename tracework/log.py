"""The interval event log: one row per activity instance.

Columns: id, case_id, activity, resource, start_time, end_time (null: ongoing), optionally enable_time, case_type and attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.functions.scalar import SECOND, micros, moment

REQUIRED = ["case_id", "activity", "resource", "start_time", "end_time"]


class InvalidLog(ValueError):
    """A log that misses columns or holds impossible intervals."""


def validate(log: DataFrame, label: str = "log") -> DataFrame:
    """The log itself, if its columns are there, no time is null and none ends before its start; one pass."""
    if missing := [c for c in REQUIRED if c not in log.columns]:
        raise InvalidLog(f"{label}: missing columns {missing}")
    found = log.agg(F.count_if(F.col("start_time").isNull() | F.col("end_time").isNull()).alias("nulls"), F.count_if(F.col("end_time") < F.col("start_time")).alias("backwards")).first()
    if found["nulls"] or found["backwards"]:
        raise InvalidLog(f"{label}: {found['nulls']} rows without a time, {found['backwards']} that end before they start")
    return log


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the table events: a case is a user's day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(ts, "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"),
        F.concat(F.lit("R"), (F.col("event_id") % 10).cast("string")).alias("resource"),
        ts.alias("start_time"),
        moment(micros(ts) + F.round(F.col("value") * 60).cast("long") * SECOND).alias("end_time"),
        F.when(F.col("user_id") % 2 == 0, "blue").otherwise("red").alias("case_type"),
        F.col("user_id"),
    )


def altered(log: DataFrame) -> DataFrame:
    """A stand-in for a simulated log: some activities renamed, some users late, some rows lost."""
    late = (F.col("user_id") % 3) * 1800 * SECOND
    return log.filter("id % 11 <> 0").withColumns(
        {"activity": F.when(F.col("id") % 7 == 0, "rework").otherwise(F.col("activity")), "start_time": moment(micros("start_time") + late), "end_time": moment(micros("end_time") + late)}
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger log: order lines as activities of their orders."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_suppkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    start = F.col("l_shipdate").cast("timestamp")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("activity"), F.col("l_suppkey").cast("string").alias("resource"),
        start.alias("start_time"), moment(micros(start) + F.col("l_quantity").cast("long") * 3600 * SECOND).alias("end_time"), F.col("o_orderpriority").alias("case_type"),
    )


def roles(log: DataFrame) -> DataFrame:
    """(resource, role) for the resources of a log, three roles in turn."""
    return log.select("resource").distinct().select("resource", F.concat(F.lit("role"), (F.substring("resource", 2, 9).cast("int") % 3).cast("string")).alias("role"))


def bounds(log: DataFrame) -> tuple[int, int]:
    """First start and last end in microseconds; two numbers on the driver."""
    r = log.agg(F.min(micros("start_time")).alias("a"), F.max(micros("end_time")).alias("b")).first()
    if r["a"] is None:
        raise InvalidLog("the log is empty")
    return r["a"], r["b"]


def case_bounds(log: DataFrame) -> DataFrame:
    """(case_id, first, last) in microseconds."""
    return log.groupBy("case_id").agg(F.min(micros("start_time")).alias("first"), F.max(micros("end_time")).alias("last"))
