"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from tracework.llm import decontaminate, divergence, fingerprints, jaccard_join, language, line_dedup, mixing, prefix_trie, quality, sharding, substring_dedup, suffix_dedup, warc
from tracework.llm.common import table


def queries() -> dict:
    return {
        "op1_warc": lambda spark, d: warc.digest(table(spark, d, "pages")),
        "op2_line_dedup": lambda spark, d: line_dedup.digest(table(spark, d, "documents")),
        "op3_decontaminate": lambda spark, d: decontaminate.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op4_quality": lambda spark, d: quality.digest(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_substring_dedup": lambda spark, d: substring_dedup.digest(table(spark, d, "documents")),
        "op6_language": lambda spark, d: language.digest(table(spark, d, "documents")),
        "op7_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
        "op8_suffix_dedup": lambda spark, d: suffix_dedup.digest(table(spark, d, "documents")),
        "op9_fingerprints": lambda spark, d: fingerprints.digest(table(spark, d, "documents")),
        "op10_jaccard_join": lambda spark, d: jaccard_join.digest(table(spark, d, "documents")),
        "op11_prefix_trie": lambda spark, d: prefix_trie.digest(table(spark, d, "conversations")),
        "op12_divergence": lambda spark, d: divergence.digest(table(spark, d, "documents")),
        "op13_sharding": lambda spark, d: sharding.digest(table(spark, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {"op1_warc": warc.SQL, "op2_line_dedup": line_dedup.SQL, "op7_mixing": mixing.sql(), "op11_prefix_trie": prefix_trie.SQL, "op12_divergence": divergence.SQL, "op13_sharding": sharding.SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
