"""What the registered queries share: the two logs, a cut, a window, and the same as DuckDB common table expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework import log
from tracework.functions.scalar import HOUR, moment
from tracework.operators.windows import candidate_cuts, subsample
from tracework.sources.files import folder, stored

__all__ = ["BASE", "DAY", "HORIZON", "Logs", "folder", "micros_out", "rounded", "stored"]

DAY = 24 * HOUR
HORIZON = 2 * DAY


@dataclass
class Logs:
    """The observed log e, its altered copy g, and a window in the middle of e."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def e(self) -> DataFrame:
        return log.observed(self.spark, self.sf_dir)

    @cached_property
    def g(self) -> DataFrame:
        return log.altered(self.e)

    @cached_property
    def roles(self) -> DataFrame:
        return stored(log.roles(self.e))  # a row a resource, of known size

    @cached_property
    def cut(self) -> int:
        a, b = log.bounds(self.e)
        return a + (b - a) // 2

    @cached_property
    def cuts(self) -> DataFrame:
        """80 cuts, found once for all features."""
        return subsample(candidate_cuts(self.e, DAY), 80)

    @property
    def end(self) -> int:
        return self.cut + HORIZON


def micros_out(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds, so that results compare exactly."""
    return df.select(*[F.unix_micros(c).alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


def rounded(df: DataFrame) -> DataFrame:
    """Six digits, a half of the last one as DuckDB has it: by the product with a million, not by the decimal text of the number."""
    return df.select(*[(F.round(F.col(c) * 1e6) / 1e6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


BASE = """
WITH e AS (
  SELECT event_id AS id, user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id, event_type AS activity, 'R' || (event_id % 10) AS resource,
    epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60) AS BIGINT) * 1000000 AS t, CASE WHEN user_id % 2 = 0 THEN 'blue' ELSE 'red' END AS case_type, user_id
  FROM events
),
g AS (
  SELECT id, case_id, CASE WHEN id % 7 = 0 THEN 'rework' ELSE activity END AS activity, resource,
    s + (user_id % 3) * 1800000000 AS s, t + (user_id % 3) * 1800000000 AS t, case_type, user_id
  FROM e WHERE id % 11 <> 0
),
p AS (SELECT cut, cut + 172800000000 AS fin FROM (SELECT min(s) + (max(t) - min(s)) // 2 AS cut FROM e)),
r AS (SELECT DISTINCT resource, 'role' || (CAST(substr(resource, 2) AS INT) % 3) AS role FROM e)
"""


def at(us: int):
    return moment(us)
