"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import checkpointed


#: Labels up to this number (two short strings each) are sent to all tasks; beyond it they are shuffled.
MOST_SENT = 100_000


def components(edges: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(node, label) for edges (a, b): the least node of each component, for nodes that have an edge.

    Each round takes the least label among neighbours and then the label of that label, so that paths halve; every round ends in
    a written table. Only counts reach the driver. A hub's edges are combined before they meet.
    """
    loops = edges.select(F.explode(F.array("a", "b")).alias("a")).withColumn("b", F.col("a"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(loops).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    small = labels.count() <= most_sent
    sent = F.broadcast if small else lambda x: x
    while True:
        near = both.join(sent(labels.select(F.col("node").alias("b"), "label")), "b")
        step = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        step = checkpointed(step)
        jumped = step.join(sent(step.select(F.col("node").alias("label"), F.col("label").alias("next"))), "label", "left")
        labels = jumped.select("node", F.coalesce("next", "label").alias("label"))
        if not jumped.filter(F.col("old") != F.coalesce("next", "label")).limit(1).count():
            return labels
