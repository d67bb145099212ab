"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Token counts are summed into cells (source, language, topic). Raking scales the cells' weights in turn to the target shares of
each marginal until all three fit within TOLERANCE, or, where they cannot all be met, until the error no longer falls; the error
left is returned beside the weights. A document is then kept with a calibrated probability: proportional to raked weight over tokens of
its cell, scaled so that the expected tokens meet the budget, at most 1; what is over 1 is dealt to the other cells until no
cell passes 1. The draw is a hash of seed and doc_id, so it repeats on every run and on every retry of a task.

Topics come from the corpus: of the words that at most one in MOST_HELD of a language's documents hold, the TOPICS words that the
most of them hold, counted over all documents, are its topic words: common enough to cover the corpus and rare enough to tell
documents apart. A document's topic is the number of the topic word that it holds most often, the first on a tie. Numbers are the
same in all languages, so that topics and languages can be raked together.

Default targets temper the observed shares: share ** temperature, normalised. Target tables may be given instead, as
DataFrames (value, share). Categories without a target get weight 0.

Defined cases: null source or language is the category '' ; null and empty texts have 0 tokens, texts without a topic word have
the topic 'other'; the probability of a cell without tokens is that of the budget's mean rate; rows that repeat a doc_id draw
alike; an empty table gives an empty result; other columns pass through, those named like the columns that stage() adds are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracework.llm.common import WORD, checkpointed, row_key

DIMENSIONS = ("source", "lang", "topic")
TOPICS, LETTERS = 8, (4, 32)
#: A topic word is held by at least two documents of its language and at most one in MOST_HELD.
MOST_HELD = 10
#: Topic words of so many languages are sent to all tasks.
MOST_LANGUAGES = 10_000
TEMPERATURE = 0.7
BUDGET = 0.8
#: Largest error of a marginal's share at which raking ends, sweeps between two looks at it, and looks in which it must fall by a tenth to go on.
TOLERANCE, SWEEPS, PATIENCE = 1e-7, 4, 2
#: Cells up to this number, a row each, are raked in one task without shuffles.
FEW_CELLS = 100_000
#: ASCII characters between a text's alphanumeric words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDED = ("mix_topic", "mix_weight", "mix_p")


def terms(text: Column) -> Column:
    """The words of a text, as written, that can be topic words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda x: F.length(x).between(*LETTERS))


def topic_words(docs: DataFrame, most: int = TOPICS) -> DataFrame:
    """(_tw_lang, _tw): the topic words of each language, best first. Each task passes on at most `most` words a language."""
    lang = F.coalesce(F.col("lang"), F.lit("")).alias("_tw_lang")
    held = docs.select(lang, F.explode(F.array_distinct(terms(F.col("text")))).alias("x")).groupBy("_tw_lang", "x").agg(F.count(F.lit(1)).alias("n"))
    sizes = checkpointed(docs.groupBy(lang).agg(F.count(F.lit(1)).alias("all")))
    # Sent to all tasks, as else words would meet by language.
    fit = held.join(F.broadcast(sizes) if sizes.count() <= MOST_LANGUAGES else sizes, "_tw_lang").filter((F.col("n") >= 2) & (F.col("n") * MOST_HELD <= F.col("all")))
    place = F.row_number().over(Window.partitionBy("_tw_lang").orderBy(F.desc("n"), "x"))
    best = fit.withColumn("k", place).filter(F.col("k") <= most).groupBy("_tw_lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("w"))
    return best.select("_tw_lang", F.transform("w", lambda e: e["x"]).alias("_tw"))


def with_topic(docs: DataFrame, known: DataFrame, out: str) -> DataFrame:
    """docs with the topic of their text, by the topic words of their language, or 'other'."""
    small = known.count() <= MOST_LANGUAGES  # a row of TOPICS short words each
    docs = docs.join(F.broadcast(known) if small else known, F.coalesce(F.col("lang"), F.lit("")) == F.col("_tw_lang"), "left")
    words, held = F.coalesce(F.col("_tw"), F.array().cast("array<string>")), F.col("_held")
    docs = docs.withColumn("_held", F.filter(terms(F.col("text")), lambda x: F.array_contains(words, x)))
    counted = F.transform(F.array_distinct(held), lambda x: F.struct(F.size(F.filter(held, lambda y: y == x)).alias("n"), (-F.array_position(words, x)).alias("o")))
    return docs.withColumn(out, F.coalesce(F.concat(F.lit("topic "), -F.array_max(counted)["o"]), F.lit("other"))).drop("_held", "_tw", "_tw_lang")


def draw(doc_id: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from seed and doc_id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)


def tempered(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """Target shares of one marginal, (value, share) up to a common factor."""
    return cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("share")).filter("share > 0")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, patience: int = PATIENCE) -> DataFrame:
    """cells with the raked weight w and `error`, the largest distance of a marginal's share from its target when raking ended.

    The cells' number is that of the categories' combinations, not of the documents. One number a sweep reaches the driver.
    """
    current = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim in DIMENSIONS:
        total = targets[dim].agg(F.sum("share").alias("_all"))
        share = targets[dim].crossJoin(F.broadcast(total)).select(F.col("value").alias(dim), (F.col("share") / F.col("_all")).alias(f"_t_{dim}"))
        current = current.join(share, dim, "left").na.fill(0.0, [f"_t_{dim}"])
    current = checkpointed(current.coalesce(4))
    few = current.count() <= FEW_CELLS
    errors: list[float] = []
    while not errors or errors[-1] > tolerance and (len(errors) <= patience or errors[-1] < 0.9 * errors[-1 - patience]):
        current = current.coalesce(1) if few else current
        for _ in range(SWEEPS):
            current = current.withColumn("error", F.lit(0.0))
            for dim in DIMENSIONS:
                margin, target = F.sum("w").over(Window.partitionBy(dim)), F.col(f"_t_{dim}")  # cells, not documents
                current = current.withColumn("_m", margin).withColumns({"w": F.when(F.col("_m") > 0, F.col("w") * target / F.col("_m")).otherwise(0.0), "error": F.greatest("error", F.abs(F.col("_m") - target))})
        current = checkpointed(current)
        errors.append(current.agg(F.max("error").alias("x")).first()["x"] or 0.0)
    return current.withColumn("error", F.lit(errors[-1])).select(*DIMENSIONS, "tokens", "w", "error")


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with p, the probability of a document: rates w / tokens scaled to the token budget, capped at 1, the excess dealt anew."""
    rated = raked.withColumn("r", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    scale, before = rated.agg((F.sum("tokens") * budget / F.sum("w")).alias("c")).first()["c"] or 0.0, -1
    while True:  # the capped cells only grow in number: it ends when none is added
        over = F.col("r") * scale >= 1
        x = rated.agg(F.sum("tokens").alias("t"), F.sum(F.when(over, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("free")).first()
        if x["t"] is None or x["full"] == before:
            break
        scale, before = (x["t"] * budget - x["full"]) / x["free"] if x["free"] > 0 else 0.0, x["full"]
        if not x["free"] > 0:
            scale = float("inf")
            break
    p = F.when(F.col("r") > 0, F.least(F.lit(1.0), F.col("r") * F.lit(scale))).otherwise(F.lit(0.0))
    return rated.withColumn("p", F.when(F.col("tokens") > 0, p).otherwise(F.lit(budget)))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, _row (hash of its text), _topic, _tokens, _weight (raked weight of its cell), _error, _p, _selected.

    Texts are read once for the topic words and once for what follows, which works on a written table of a few dozen bytes a document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", "text", "source", "lang")
    marked = checkpointed(
        with_topic(docs, checkpointed(topic_words(docs)), "_topic").select(
            "doc_id", row_key(F.col("text")).alias("_row"), "_topic", F.regexp_count(text, F.lit(WORD)).cast("long").alias("_tokens"),
            F.coalesce(F.col("source"), F.lit("")).alias("_src"), F.coalesce(F.col("lang"), F.lit("")).alias("_lng"),
        )
    )
    cells = checkpointed(marked.groupBy(F.col("_src").alias("source"), F.col("_lng").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")).coalesce(4))
    targets = targets or {d: tempered(cells, d, temperature) for d in DIMENSIONS}
    found = probabilities(rake(cells, targets), budget).select(F.col("source").alias("_src"), F.col("lang").alias("_lng"), F.col("topic").alias("_topic"), F.col("w").alias("_weight"), F.col("error").alias("_error"), F.col("p").alias("_p"))
    joined = marked.join(checkpointed(found.coalesce(4)), ["_src", "_lng", "_topic"], "left")
    return joined.withColumn("_selected", draw(F.col("doc_id"), seed) < F.col("_p")).drop("_src", "_lng")


def digest(docs: DataFrame) -> DataFrame:
    """Per document its cell, probability and draw, and the error that raking left."""
    out = mixed(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("cell_weight"), F.round("_error", 6).alias("error"), F.round("_p", 6).alias("p"), F.col("_selected").alias("selected"))


def stage(docs: DataFrame) -> DataFrame:
    """The sampled documents, with their cell's weight and probability."""
    out = mixed(docs.select("doc_id", "text", "lang", "source")).filter("_selected").dropDuplicates(["doc_id", "_row"])
    out = out.select(F.col("doc_id").alias("_id"), "_row", F.col("_topic").alias(ADDED[0]), F.round("_weight", 6).alias(ADDED[1]), F.round("_p", 6).alias(ADDED[2]))
    own = docs.drop(*ADDED)
    keyed = own.withColumn("_mx_key", row_key(F.col("text")))
    return keyed.join(out, keyed["doc_id"].eqNullSafe(out["_id"]) & (keyed["_mx_key"] == out["_row"])).select(*[keyed[c] for c in own.columns], *[out[c] for c in ADDED])


def sql(rounds: int = 10) -> str:
    """DuckDB SQL for digest(): raking in a recursive query that ends as rake() does, rounds of dealing written out, more than it takes."""
    out = f"""
WITH RECURSIVE a AS (SELECT row_number() OVER () AS i, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents),
v AS (SELECT i, lang, unnest(regexp_split_to_array(x, '{BETWEEN}')) AS y FROM a),
vc AS MATERIALIZED (SELECT i, lang, y, count(*) AS n FROM v WHERE length(y) BETWEEN {LETTERS[0]} AND {LETTERS[1]} GROUP BY ALL),
nl AS (SELECT lang, count(*) AS n FROM a GROUP BY lang),
tw AS MATERIALIZED (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY c DESC, y) AS o FROM (SELECT lang, y, count(*) AS c FROM vc GROUP BY ALL) JOIN nl USING (lang) WHERE c >= 2 AND c * {MOST_HELD} <= n QUALIFY o <= {TOPICS}),
tt AS (SELECT i, 'topic ' || arg_max(o, {{'n': n, 'o': -o}}) AS topic FROM vc JOIN tw USING (lang, y) GROUP BY i),
d AS MATERIALIZED (SELECT doc_id, source, lang, len(regexp_extract_all(x, '{WORD}')) AS n_tokens, coalesce(topic, 'other') AS topic FROM a LEFT JOIN tt USING (i)),
k AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
"""
    for dim in DIMENSIONS:
        out += f"g_{dim} AS (SELECT {dim}, pow(sum(tokens), {TEMPERATURE}) AS s FROM k GROUP BY {dim} HAVING sum(tokens) > 0), h_{dim} AS (SELECT {dim}, s / (SELECT sum(s) FROM g_{dim}) AS t FROM g_{dim}),\n"
    share = " ".join(f"WHEN {i} THEN t_{dim}" for i, dim in enumerate(DIMENSIONS))
    value = " ".join(f"WHEN {i} THEN {dim}" for i, dim in enumerate(DIMENSIONS))
    out += f"""k0 AS (SELECT k.*, {', '.join(f"coalesce(h_{dim}.t, 0) AS t_{dim}" for dim in DIMENSIONS)} FROM k {' '.join(f"LEFT JOIN h_{dim} ON k.{dim} = h_{dim}.{dim}" for dim in DIMENSIONS)}),
it AS (
  SELECT 0 AS n, source, lang, topic, tokens, {', '.join(f"t_{dim}" for dim in DIMENSIONS)}, tokens AS w, 1.0::DOUBLE AS error FROM k0
  UNION ALL
  SELECT n + 1, source, lang, topic, tokens, {', '.join(f"t_{dim}" for dim in DIMENSIONS)}, CASE WHEN m > 0 THEN w * t / m ELSE 0 END, greatest(CASE WHEN n % 3 = 0 THEN 0 ELSE error END, max(abs(m - t)) OVER ())
  FROM (SELECT *, CASE n % 3 {share} END AS t, sum(w) OVER (PARTITION BY CASE n % 3 {value} END) AS m FROM it WHERE n < 3000 AND NOT (n > 0 AND n % {3 * SWEEPS} = 0 AND error <= {TOLERANCE}))
),
wn AS MATERIALIZED (SELECT * FROM it WHERE n = (SELECT max(n) FROM it)),
er AS (SELECT round(max(error), 6) AS error FROM wn),
r AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS r FROM wn),
c0 AS MATERIALIZED (SELECT sum(tokens) * {BUDGET} / sum(w) AS c FROM r),
"""
    for i in range(rounds):
        out += f"c{i + 1} AS MATERIALIZED (SELECT CASE WHEN free > 0 THEN (t * {BUDGET} - full_t) / free ELSE 0 END AS c FROM (SELECT sum(tokens) AS t, sum(CASE WHEN r * c >= 1 THEN tokens ELSE 0 END) AS full_t, sum(CASE WHEN r * c < 1 THEN w ELSE 0 END) AS free FROM r, c{i})),\n"
    return out + f"""p AS (SELECT source, lang, topic, w, CASE WHEN tokens > 0 THEN least(1.0, r * c) ELSE {BUDGET} END AS p FROM r, c{rounds})
SELECT doc_id, d.topic, n_tokens::BIGINT AS n_tokens, round(w, 6) AS cell_weight, er.error, round(p, 6) AS p, ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < p AS selected
FROM d JOIN p USING (source, lang, topic), er
"""
