"""Tables written on the way: in a folder that driver and executors share, one a run, which goes when the driver ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or, where it is unset, a folder in the warehouse.

    Executors of a cluster do not see a driver's local disk; a local warehouse is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or "://" not in base):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local one")
    return base + "/_scratch"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in this run's own folder."""
    shared = shared_dir(spark)
    run = next((path for owner, _, path in _runs if owner is spark and path.startswith(shared + "/")), None)
    if run is None:
        run = f"{shared}/tracework-{uuid.uuid4().hex}"
        if not _runs:
            atexit.register(clear_scratch)
        _runs.append((spark, spark._jsc.hadoopConfiguration(), run))
    return f"{run}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: df is written once and read from there, so that nothing computes it anew and executors may be lost."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch() -> None:
    """Remove what this driver's runs have written on the way; results that were not written elsewhere are lost."""
    while _runs:
        spark, conf, path = _runs.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001 - the JVM has ended before: the folder stays for its owner to remove
            continue
