"""Connected components of edge tables as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the (u, v) edges.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so that the
    number of rounds grows with the logarithm of a chain's length. Both steps join on node ids; hot nodes are
    pre-aggregated by the grouped minimum, or split by adaptive execution.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("low"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        step = cut(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
