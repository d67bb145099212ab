"""Files in and out, by Spark's readers and writers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tracework.functions.scalar import parse_datetime
from tracework.log import REQUIRED, InvalidLog
from tracework.sources.scratch import scratch_path, stored

__all__ = ["stored"]

#: Times in JSON, to the microsecond.
EXACT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TIMES = ("enable_time", "start_time", "end_time")
#: Names that simulators write and those used here.
CAMEL = {"CaseId": "case_id", "Activity": "activity", "Resource": "resource", "StartTime": "start_time", "EndTime": "end_time", "EnabledTime": "enable_time", "case_id": "case_id", "enabled_time": "enable_time"}
KEPT = ["case_id", "activity", "resource", "enable_time", "start_time", "end_time"]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that a run writes and reads again."""
    return scratch_path(spark, name)


def _named(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in rename.items() if a in df.columns and a != b})


def read_event_log(spark: SparkSession, path: str, rename: dict[str, str] | None = None, required: list[str] | None = None) -> DataFrame:
    """A log from CSV (plain or gzip) or Parquet: renamed, times parsed in UTC, required columns there. Types are not guessed."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    df = _named(df, rename or CAMEL)
    if missing := [c for c in (required or REQUIRED) if c not in df.columns]:
        raise InvalidLog(f"missing columns {missing}")
    return df.withColumns({c: parse_datetime(F.col(c)) for c in TIMES if c in df.columns and dict(df.dtypes)[c] == "string"})


def read_mapped(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, missing ends): columns by a mapping of own to standard names, identity where it is silent; times as timestamps, null if bad."""
    df = _named(spark.read.csv(path, header=True), mapping or {})
    if missing := [c for c in ("CaseId", "Resource", "Activity", "StartTime", "EndTime") if c not in df.columns]:
        raise InvalidLog(f"missing columns {missing}")
    df = _named(df, CAMEL)
    df = df.withColumns({c: parse_datetime(F.col(c)) for c in TIMES if c in df.columns})
    return df, df.agg(F.count_if(F.col("end_time").isNull()).alias("missing_ends"))


def parse_mapping(spark: SparkSession, text: str) -> dict[str, str]:
    """A column mapping given as JSON text; a handful of names."""
    got = spark.range(1).select(F.from_json(F.lit(text), "map<string,string>").alias("m")).first()["m"]
    return dict(got or {})


def canonical(df: DataFrame) -> DataFrame:
    """The standard columns, and case_type where there is one."""
    df = _named(df, CAMEL)
    return df.select(*[c for c in [*KEPT, "case_type"] if c in df.columns])


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """(resource, role) from the resource profiles of a parameter file."""
    p = spark.read.json(path, multiLine=True).select(F.explode("resource_profiles").alias("p"))
    return p.select(F.col("p.name").alias("role"), F.explode("p.resource_list").alias("r")).select(F.col("r.id").alias("resource"), "role")


def declared_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(family, names): declared attribute names of a parameter file, each once, in order."""
    shape = "case_attributes array<struct<name:string>>, global_attributes array<struct<name:string>>, event_attributes array<struct<event_id:string,attributes:array<struct<name:string>>>>"
    raw = spark.read.schema(shape).json(path, multiLine=True)
    families = {"case": F.col("case_attributes.name"), "global": F.col("global_attributes.name"), "event": F.flatten(F.transform("event_attributes", lambda e: e["attributes"]["name"]))}
    items = F.array(*[F.struct(F.lit(k).alias("family"), F.array_distinct(F.filter(F.coalesce(v, F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("names")) for k, v in families.items()])
    return raw.select(F.explode(items).alias("i")).select("i.family", "i.names")


def present(names: list[str], df: DataFrame) -> list[str]:
    """Those of the names that are columns."""
    return [n for n in names if n in df.columns]


#: Element names of the process model notation.
EVENTS = ("startEvent", "intermediateCatchEvent", "intermediateThrowEvent", "endEvent")
GATEWAYS = ("exclusiveGateway", "parallelGateway", "inclusiveGateway", "complexGateway", "eventBasedGateway")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, flows) of a BPMN file: tasks, events and gateways with their names, and sequence flows, at any depth.

    The file is read once, as one text; elements are known by their local names, whatever prefix their namespace has, or none.
    Elements without a name are called after their kind and id.
    """
    text = spark.read.text(path, wholetext=True)
    at = lambda kind, more: F.xpath("value", F.lit(f"//*[local-name()='{kind}'][@id]{more}"))

    def elements(kind: str) -> Column:
        unnamed = F.concat(F.lit(f"Unnamed {'Task' if kind == 'task' else kind} "), F.lit(""))
        node = lambda i, n: F.named_struct(F.lit("node_id"), i, F.lit("kind"), F.lit(kind), F.lit("name"), n)
        named = F.zip_with(at(kind, "[@name]/@id"), at(kind, "[@name]/@name"), node)
        return F.concat(named, F.transform(at(kind, "[not(@name)]/@id"), lambda i: node(i, F.concat(unnamed, i))))

    nodes = text.select(F.explode(F.concat(*[elements(k) for k in ("task", *EVENTS, *GATEWAYS)])).alias("n")).select("n.*")
    ends = [at("sequenceFlow", f"[@sourceRef and @targetRef]/@{a}") for a in ("id", "sourceRef", "targetRef")]
    flows = text.select(F.explode(F.arrays_zip(*[c.alias(n) for c, n in zip(ends, ("flow_id", "source", "target"), strict=True)])).alias("f"))
    return nodes, flows.select(*[F.col("f").getField(n).alias(n) for n in ("flow_id", "source", "target")])


def prefix(log: DataFrame, cut: Column) -> DataFrame:
    """What began before a cut, under a simulator's names, times as ISO text with microseconds and offset."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias(c)
    out = log.filter(F.col("start_time") < cut)
    cols = [F.col(c) if c not in TIMES else iso(c) for c in [*KEPT, "case_type"] if c in log.columns]
    return out.select(*cols).withColumnsRenamed({v: k for k, v in CAMEL.items() if k[0].isupper()})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_outputs(folder: str, as_json: tuple[str, ...] = ("models", "metadata"), **tables: DataFrame) -> None:
    """Each table beneath a folder: results, utilisation, rankings, samples, evaluations as Parquet, models and metadata as JSON lines."""
    for name, df in tables.items():
        (df.write.mode("overwrite").json if name in as_json else df.write.mode("overwrite").parquet)(f"{folder.rstrip('/')}/{name}")


def read_output(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of write_outputs(); JSON ones by their schema."""
    path = f"{folder.rstrip('/')}/{name}"
    return spark.read.schema(schema).json(path) if schema else spark.read.parquet(path)


def write_sorted(log: DataFrame, path: str, file_bytes: int = 128 << 20) -> None:
    """The log sorted by start (ties by id): files hold ranges of time, in order of their names, and are sorted inside.

    How many files follows from the bytes of all values. A manifest beside them has a row a file: its first and last start, its
    rows, and how many rows lie before it.
    """
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in log.columns), F.lit(0))
    files = max(1, -(-(log.agg(F.sum(size).alias("b")).first()["b"] or 0) // file_bytes))
    sorted_rows = log.repartitionByRange(files, "start_time", "id").sortWithinPartitions("start_time", "id")
    sorted_rows.write.mode("overwrite").parquet(path)
    held = log.sparkSession.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file"))
    bounds = held.agg(F.min("start_time").alias("first"), F.max("start_time").alias("last"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(_manifest(path))


def _manifest(path: str) -> str:
    """A folder that readers of the log skip, as its name begins with _."""
    return f"{path.rstrip('/')}/_manifest"


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A log of write_sorted() with `place`, each row's position over all files: that in its file after what the manifest says lies before it."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    known = spark.read.parquet(_manifest(path)).select(F.col("file").alias("_file"), "before")
    return rows.join(known, "_file").withColumn("place", F.col("before") + F.col("_at")).drop("_file", "_at", "before")


def read_between(spark: SparkSession, path: str, start: Column, end: Column) -> DataFrame:
    """Rows of a log of write_sorted() that start in [start, end]; other files than those that may hold some are not opened."""
    held = spark.read.parquet(_manifest(path)).filter((F.col("first") <= end) & (F.col("last") >= start)).select("file")
    names = [f"{path.rstrip('/')}/{r['file']}" for r in held.collect()]  # files of the asked time
    rows = spark.read.parquet(*names) if names else spark.read.parquet(path).limit(0)
    return rows.filter(F.col("start_time").between(start, end))


def write_snapshot(folder: str, cases: DataFrame, last_arrival: DataFrame, globals_: DataFrame | None = None) -> None:
    """A snapshot as JSON lines: one header, one object per case."""
    head = last_arrival.select(F.col("last_case_arrival"))
    if globals_ is not None:
        head = head.crossJoin(F.broadcast(globals_.select(F.struct(*globals_.columns).alias("global_attributes"))))
    head.write.mode("overwrite").option("timestampFormat", EXACT).json(f"{folder.rstrip('/')}/header")
    cases.write.mode("overwrite").option("timestampFormat", EXACT).json(f"{folder.rstrip('/')}/cases")


def read_snapshot(spark: SparkSession, folder: str, cases: StructType, globals_: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(header, cases) of a snapshot, nested arrays and all, by the schema that the cases were written with."""
    head = StructType([StructField("last_case_arrival", LongType())] + ([StructField("global_attributes", globals_)] if globals_ else []))
    read = lambda schema, name: spark.read.schema(schema).option("timestampFormat", EXACT).json(f"{folder.rstrip('/')}/{name}")
    return read(head, "header"), read(cases, "cases")


def read_snapshot_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id) of a snapshot; an absent or broken one has none."""
    try:
        return spark.read.schema("case_id string").option("mode", "DROPMALFORMED").json(f"{folder.rstrip('/')}/cases").filter("case_id IS NOT NULL").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "case_id string")


def recompute_rankings(spark: SparkSession, results: str, out: str, n_bootstrap: int) -> DataFrame:
    """Rankings from stored results, written beside them."""
    from tracework.operators.ranking import rankings

    rankings(spark.read.parquet(results), n_bootstrap).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def fixed_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(log, bad): a log whose times are repaired to milliseconds without zone; times that cannot be read are null and counted."""
    from tracework.functions.scalar import format_ms

    df = spark.read.csv(path, header=True)
    names = [c for c in ("start_time", "end_time", "enabled_time", "enable_time") if c in df.columns]
    parsed = df.withColumns({c: parse_datetime(F.col(c)) for c in names})
    bad = parsed.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return parsed.withColumns({c: format_ms(F.col(c)) for c in names}).withColumnsRenamed({"enabled_time": "enable_time"}), bad
