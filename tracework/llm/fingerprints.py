"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits. DataFrame functions only.

A document's five-word shingles (ASCII white space separates words, case is folded; fewer words: the whole sequence) are
hashed once. The top eight bits of a hash choose one of 256 bins, each bin keeps its least hash. An empty bin borrows from a
filled one: it probes bins in an order that depends on its own number alone (a hash of bin and attempt, then all filled bins
by a hash of both numbers), so that two documents agree on a borrowed bin as often as on a filled one. Four low-order bits of
every bin are packed as one hex digit: the fingerprint is 128 bytes, written as 256 digits. Two fingerprints agree by chance in
1/16 of their digits; likeness takes that share out.

Defined cases: null text is the empty text; a text without words has the empty fingerprint, which is like (1.0) another empty
one and unlike (0.0) all else; equal texts have equal fingerprints; rows that repeat a doc_id follow one another by a hash of
their text; the empty table gives an empty result; other columns pass through `fingerprinted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.llm.common import checkpointed, row_key, words

BINS, BITS, SHINGLE = 256, 4, 5
ATTEMPTS = 24
#: Documents that a window task sorts at a time, and the most boundaries between such ranges (8 bytes each).
ROWS_A_RANGE, MOST_RANGES = 500, 65536


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of its column `text` as `out`."""

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, 56)

    def digit(h: Column) -> Column:
        return F.hex(h.bitwiseAND(2**BITS - 1))

    w, h, m, s, d = (f"_{out}_{x}" for x in "whmsd")
    df = df.withColumn(w, words(F.lower(F.col(text))))
    shingles = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    hashes = F.when(F.size(w) >= SHINGLE, shingles).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(h, F.sort_array(hashes)).drop(w)
    # In sorted order the first hash of each bin is its least. Bins come as 128..255, 0..127, as longs are signed; hence the turn.
    least = F.filter(F.col(h), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(h), i - 1))))
    df = df.withColumn(m, least).drop(h)
    place = lambda x: F.pmod(bin_of(x) + BINS // 2, F.lit(BINS)).cast("int")
    gap = lambda x, i: place(x) - F.coalesce(place(F.get(F.col(m), i - 1)), F.lit(-1)) - 1
    df = df.withColumn(s, F.rpad(F.array_join(F.transform(m, lambda x, i: F.concat(F.repeat(F.lit("-"), gap(x, i)), digit(x))), ""), BINS, "-"))
    df = df.withColumn(d, F.transform(F.split(s, ""), lambda x: F.when(x != "-", x)))

    def borrowed(i: Column) -> list[Column]:
        """The bins that an empty one tries in turn; nulls are empty."""
        tried = [F.get(F.col(d), F.pmod(F.xxhash64(i, F.lit(j)), F.lit(BINS)).cast("int")) for j in range(1, ATTEMPTS + 1)]
        nearest = F.array_min(F.transform(F.col(m), lambda x: F.struct(F.xxhash64(i, place(x)).alias("o"), digit(x).alias("d"))))["d"]
        return [*tried, nearest]

    dense = F.array_join(F.transform(d, lambda x, i: F.coalesce(x, *borrowed(i))), "")
    return df.withColumn(out, F.when(F.size(m) == 0, "").when(F.instr(s, "-") == 0, F.col(s)).otherwise(dense)).drop(m, s, d)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity from two fingerprints: the share of equal digits, less what agrees by chance."""

    def part(x: Column, i: Column) -> Column:
        return F.conv(F.substr(x, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")

    def unlike(i: Column) -> Column:
        x = part(a, i).bitwiseXOR(part(b, i))
        folded = x.bitwiseOR(F.shiftright(x, 1))
        folded = folded.bitwiseOR(F.shiftright(folded, 2))
        return F.bit_count(folded.bitwiseAND(0x11111111))

    chance = 2.0**-BITS
    differ = F.aggregate(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), F.lit(0), lambda acc, i: acc + unlike(i))
    raw = F.greatest(F.lit(0.0), (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).when(a == b, 1.0).otherwise(raw)


def with_next(docs: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each document beside the next by doc_id, the first after the last.

    Documents are dealt into ranges of doc_id, whose bounds are one row of quantiles, and each range also gets the first
    document of the next: no window runs over all rows.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("th", row_key(F.col("text")))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // rows_a_range))
    steps = max(1, ranges - 1).bit_length()
    at = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)]) if ranges > 1 else F.array(F.lit(0.5))
    bounds = checkpointed(docs.agg(F.percentile_approx("doc_id", at, min(1_000_000, 20 * ranges)).alias("bounds"), F.min("doc_id").alias("least")))
    halves = F.array(*[F.lit(2**k) for k in range(steps, -1, -1)])
    x = F.coalesce(F.col("doc_id"), F.col("least"), F.lit(0))
    found = F.aggregate(halves, F.lit(0), lambda acc, k: F.when(F.get("bounds", acc + k - 1) <= x, acc + k).otherwise(acc))
    dealt = base.crossJoin(F.broadcast(bounds)).withColumn("part", found).drop("bounds", "least")
    heads = dealt.groupBy("part").agg(F.min(F.struct("doc_id", "th")).alias("head"))
    order = Window.orderBy("part")  # one row a range, bounded by MOST_RANGES
    heads = heads.select("part", "head", F.lag("part").over(order).alias("before"), F.max("part").over(Window.partitionBy(F.lit(0))).alias("last"))
    heads = checkpointed(heads.select(F.col("part").alias("p"), F.coalesce("before", "last").alias("to"), F.col("head.doc_id").alias("i"), F.col("head.th").alias("t")).coalesce(1))
    extra = dealt.join(F.broadcast(heads), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    extra = extra.select("doc_id", "text", "th", F.col("to").alias("part"), F.lit(True).alias("extra"))
    both = fingerprinted(dealt.withColumn("extra", F.lit(False)).unionByName(extra), "text", "fp")
    w = Window.partitionBy("part").orderBy("extra", "doc_id", "th")
    both = both.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)})
    return both.filter("NOT extra").select("doc_id", "text", "fp", "next_text", "next_fp")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    both = with_next(docs).withColumns({"n": F.length("text").cast("long"), "m": F.floor(F.length("text") / 4).cast("int")})
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n") - F.col("m")).cast("int")), F.substr("next_text", F.lit(1), F.col("m")))
    both = fingerprinted(both.withColumn("edited", edited), "edited", "efp")
    return both.select(
        "doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
