"""Small pieces that several operators share."""

from __future__ import annotations

import ctypes

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.sources.scratch import scratch_path
from tracework.sources.scratch import stored as checkpointed

__all__ = ["checkpointed", "scratch_path"]

#: ASCII white space, as a character class body for Java and RE2 patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def released() -> None:
    """Give memory that a task no longer needs back to the system, as Python workers live on and wait beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def least_hashed(rows: DataFrame, key: str, most: int) -> pd.DataFrame:
    """(doc_id, key) of the `most` ids of each value of key whose doc_id has the least hash, on the driver.

    Repeated rows are one. Values are counted first; of a frequent one only rows with a hash below about 2 most / count leave their tasks, so that no
    value is gathered in one task, and the driver gets about twice what it keeps.
    """
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    rows = rows.select("doc_id", key).distinct()
    counts = rows.groupBy(F.col(key).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    near = rows.join(counts, F.col(key) == F.col("_value")).filter(u < (2 * most + 50) / F.col("_n"))
    got = near.select("doc_id", key, u.alias("_u")).toPandas()
    return got.sort_values(["_u", "doc_id"]).groupby(key, sort=False).head(most)[["doc_id", key]]


def row_key(text: Column) -> Column:
    """A document row is known by its doc_id and this hash: two rows with one doc_id and different texts stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one narrow pass, one number on the driver; batch counts derive from it."""
    got = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()
    return int(got["b"] or 0)
