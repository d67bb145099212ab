"""Shards of nearly equal bytes by longest-processing-time scheduling.

Documents of one text are a group, which stays together. Groups, the largest first (equal sizes by the MD5 of their text), go one
after the other to the shard that has the least bytes so far (the one of the lowest number where loads are equal). Only the sizes
decide, so the heap runs over the histogram of group sizes: a run of equal groups is dealt by whole rounds. While the shards within
one size of the least loaded one take a group each, in the order of their loads, that order repeats until another shard's load is
reached; each such stretch is one row (size, first and last position, the shards of a round). A corpus of B bytes has fewer than
sqrt(2 B) different sizes, and a size at most some twice as many stretches as there are shards: all that the one task with the heap
sees. Groups are then numbered along Spark's range partitioning, and find their stretch by size and position.

Shards differ by less than the size of the group that their last load took; a group that is larger than the mean shard has to
exceed it, as it stays together.

Defined cases: a null text counts as the empty text, with the size 16 of the document itself; rows that repeat an id and its text
are documents of their own, in one shard; a null doc_id comes first in its group; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import checkpointed
from tracework.operators.running import numbered

SHARDS, OVERHEAD = 40, 16
#: Rows (some sixty bytes each) that a task numbers.
ROWS_A_RANGE = 100_000


def dealt(sizes: Iterator[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(size, start, end, round) for (size, groups), sizes descending: groups number start to end - 1 of all go to the shards of the
    round in turn. The rows of a size cover its groups; numbers run on over all sizes."""
    heap = [(0, k) for k in range(shards)]
    at = 0
    for size, n in sizes:
        end = at + n
        while at < end:
            load, k = heap[0]
            turn = []  # the shards that get a group each before the least loaded one gets another
            while heap and heap[0] < (load + size, k) and len(turn) < end - at:
                turn.append(heapq.heappop(heap))
            rounds = (end - at) // len(turn)
            if heap:  # as long as the last of the turn stays below the next shard's load
                last, of = turn[-1]
                upto, other = heap[0]
                rounds = min(rounds, max(1, (upto - last - (of > other)) // size + 1))
            yield size, at, at + rounds * len(turn), [k for _, k in turn]
            at += rounds * len(turn)
            for load, k in turn:
                heapq.heappush(heap, (load + rounds * size, k))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of each document: the text is read once, its group is known by an MD5 from then on."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))


def assigned(docs: DataFrame, shards: int = SHARDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, key, place, shard) of each document, place the number of its group by size."""
    rows = checkpointed(keyed(docs))
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"))
    placed = checkpointed(numbered(groups.withColumn("order", -F.col("total")), "order", "key", rows_a_range=rows_a_range).select("key", "total", F.col("n").alias("place")))

    def run(batches):
        sizes = ((int(t), int(n)) for b in batches for t, n in zip(b["total"], b["n"], strict=True))
        found, most = [], 10_000
        for row in dealt(sizes, shards):
            found.append(row)
            if len(found) == most:
                yield pd.DataFrame(found, columns=["of", "start", "end", "round"])
                found = []
        yield pd.DataFrame(found, columns=["of", "start", "end", "round"])

    histogram = placed.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    stretches = checkpointed(histogram.repartition(1).sortWithinPartitions(F.desc("total")).mapInPandas(run, "of long, start long, end long, round array<int>"))
    met = placed.join(stretches, (F.col("total") == F.col("of")) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("end")))
    turn = ((F.col("place") - F.col("start")) % F.size("round")).cast("int")
    return rows.join(met.select("key", "place", F.get("round", turn).alias("shard")), "key")


def sharded(docs: DataFrame, shards: int = SHARDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """assigned() with slot, the position in the shard: its groups by size, the documents of a group by id."""
    rows = checkpointed(assigned(docs, shards, rows_a_range))
    out = numbered(rows, "shard", "place", "doc_id", rows_a_range=rows_a_range)
    sizes = rows.groupBy(F.col("shard").alias("of")).agg(F.count(F.lit(1)).alias("n_of")).collect()  # a row a shard
    start, before = {}, 0
    for r in sorted(sizes, key=lambda r: r["of"]):
        start[r["of"]] = before
        before += r["n_of"]
    first = F.get(F.lit([start.get(k, 0) for k in range(shards)]), F.col("shard"))
    return out.withColumn("slot", F.col("n") - first).drop("n")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents with all their columns as Parquet, a folder a shard (shard=0 and so on), split into files by Spark's settings."""
    name = "_shard" if "shard" in docs.columns else "shard"
    place = assigned(docs, shards).select(F.col("key").alias("_sh_of"), F.col("shard").alias("_sh")).distinct()
    keyed_docs = docs.withColumn("_sh_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    out = keyed_docs.join(place, F.col("_sh_key") == F.col("_sh_of")).drop("_sh_key", "_sh_of").withColumnRenamed("_sh", name)
    out.repartition(name, F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy(name).parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 (polynomial 0xEDB88320) of a text's UTF-8 bytes; DuckDB has no function for it.
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295::BIGINT))"""
_TABLE = """list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""

#: DuckDB SQL for digest(): groups one after the other, each to the least loaded shard.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(text, '')) AS key FROM documents),
g AS (SELECT key, total, row_number() OVER (ORDER BY total DESC, key) AS k FROM (SELECT key, sum(size)::BIGINT AS total FROM d GROUP BY 1)),
l AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS shard, list_transform(range({SHARDS}), lambda i: 0::BIGINT) AS loads
  UNION ALL
  SELECT g.k, j - 1, list_transform(loads, lambda x, i: CASE WHEN i = j THEN x + g.total ELSE x END)
  FROM (SELECT k, loads, list_position(loads, list_min(loads))::BIGINT AS j FROM l) AS s JOIN g ON g.k = s.k + 1),
t AS (SELECT {_TABLE} AS crc_table),
c AS (SELECT key, {_CRC.format(x="text")} AS crc FROM (SELECT key, any_value(text) AS text FROM d GROUP BY 1), t)
SELECT d.doc_id, d.size::BIGINT AS size, c.crc AS text_crc32, 'bytes' AS law, l.shard::INT AS shard,
  row_number() OVER (PARTITION BY l.shard ORDER BY g.k, d.doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN g USING (key) JOIN l USING (k) JOIN c USING (key)
"""
