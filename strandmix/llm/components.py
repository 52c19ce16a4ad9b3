"""Connected components by repeated minimum labels and pointer jumping, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (src, dst): the smallest node that can be reached.

    Each round takes the least label among neighbours, then the label of that label, so rounds grow with the logarithm of the longest
    path in the usual case. Labels are written between rounds; hot nodes combine before the shuffle or are split by skew joins.
    """
    both = written(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    table = labels = written(both.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("node"), F.least("src", "least").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("near")), "dst").groupBy("src").agg(F.min("near").alias("near"))
        lower = labels.join(near.select(F.col("src").alias("node"), "near"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(lower.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")))
        done = new.where("old != component").isEmpty()
        discard(table)
        table, labels = new, new.select("node", "component")
        if done:
            discard(both)
            labels._strandmix_path = table._strandmix_path  # for ``discard``
            return labels
