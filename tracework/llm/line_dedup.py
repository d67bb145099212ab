"""Line deduplication by overlapping three-line windows.

Every run of three consecutive lines is a window, known by a 128-bit hash of its trimmed lines. Of all occurrences of a
window in the corpus the first, by (doc_id, line number), stays; each later one removes the three lines it covers.
Covered positions are merged before lines are taken out. All windows are judged on the input.

Defined cases: null and empty texts have no window and come back as the empty text; texts of fewer than three lines are
unchanged; windows of three blank lines are ignored; a null doc_id sorts first; rows that repeat a doc_id and its text
are one occurrence, so they keep the same lines; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import row_key

WINDOW = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: F.trim(x))
    per_doc = docs.select(F.col("doc_id").alias("_ld_id"), row_key(F.col("text")).alias("_ld_row"), lines.alias("_l")).filter(F.size("_l") >= width)

    def window(i):
        parts = [F.element_at("_l", (i + k + 1).cast("int")) for k in range(width)]
        return F.struct(i.cast("int").alias("pos"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("~"), *parts).alias("h2"), F.greatest(*[F.length(p) for p in parts]).alias("most"))

    hashed = F.transform(F.sequence(F.lit(0), F.size("_l") - width), window)
    return per_doc.select("_ld_id", "_ld_row", F.explode(hashed).alias("w")).filter("w.most > 0").select("_ld_id", "_ld_row", "w.pos", "w.h1", "w.h2")


def later_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(_ld_id, _ld_row, _ld_starts): where each document's windows repeat an earlier one.

    The aggregation combines on the map side, so that a window which a third of all documents hold costs one row a task; the
    join back has one row per window on its right side, and adaptive execution splits a hot left side.
    """
    found = _windows(docs, width)
    place = F.struct("_ld_id", "_ld_row", "pos")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("NOT first <=> last").select("h1", "h2", "first")
    later = found.join(repeated, ["h1", "h2"]).filter(~F.struct("_ld_id", "_ld_row", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("_ld_id", "_ld_row").agg(F.collect_set("pos").alias("_ld_starts"))


def deduplicate_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with _ld_kept (the remaining text), _ld_lines and _ld_removed added."""
    found = later_windows(docs, width)
    keyed = docs.withColumn("_ld_key", row_key(F.col("text")))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_ld_id"]) & (keyed["_ld_key"] == found["_ld_row"]), "left")
    lines = F.split(F.col("text"), "\n")
    covered = F.flatten(F.transform("_ld_starts", lambda s: F.sequence(s, s + (width - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.array_distinct(covered))
    out = joined.withColumn("_ld_keep", F.when(F.col("_ld_starts").isNotNull(), kept))
    text = F.when(F.col("_ld_starts").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_ld_keep", lambda i: F.element_at(lines, i + 1)), "\n"))
    n_lines = F.when(F.length("text") > 0, F.size(lines)).otherwise(0)
    return out.withColumns(
        {
            "_ld_kept": F.coalesce(text, F.lit("")),
            "_ld_lines": n_lines.cast("long"),
            "_ld_removed": F.when(F.col("_ld_starts").isNull(), 0).otherwise(F.size(lines) - F.size("_ld_keep")).cast("long"),
        }
    ).drop("_ld_key", "_ld_id", "_ld_row", "_ld_starts", "_ld_keep")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the remaining text."""
    out = deduplicate_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), F.sha2("_ld_kept", 256).alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """Documents with the repeated lines gone; a document whose lines all go leaves the corpus, one that was empty before stays."""
    out = deduplicate_lines(docs)
    out = out.filter((F.col("_ld_removed") == 0) | (F.col("_ld_lines") > F.col("_ld_removed")))
    return out.withColumns({"text": F.when(F.col("_ld_removed") > 0, F.col("_ld_kept")).otherwise(F.col("text")), "n_chars": F.when(F.col("_ld_removed") > 0, F.length("_ld_kept").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


#: DuckDB SQL for digest().
SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, p AS pos, trim(ls[p + 1]) || chr(10) || trim(ls[p + 2]) || chr(10) || trim(ls[p + 3]) AS k
  FROM (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) AS p FROM l)
),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS rn FROM w WHERE length(k) > 2),
c AS (SELECT DISTINCT doc_id, pos + o AS pos FROM f, (SELECT unnest(range(0, 3)) AS o) WHERE rn > 1),
x AS (SELECT doc_id, ls[p + 1] AS line, p AS pos FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS p FROM l)),
k AS (
  SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.pos) FILTER (WHERE c.pos IS NULL) AS kept, count(c.pos) AS n_removed
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id
)
SELECT l.doc_id, CASE WHEN length(text) > 0 THEN len(ls) ELSE 0 END AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
