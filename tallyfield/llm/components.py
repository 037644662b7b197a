"""Connected components of a graph given by edges, by smallest labels with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node with an edge; ``label`` is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label; the tables
    are written between rounds. Aggregations combine before the shuffle, so a node may have any number of edges.
    An empty graph gives an empty table; repeated edges and loops change nothing.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(
        edges.select(F.col(b).alias("node"), F.col(a).alias("other"))
    )
    both = cut_lineage(both.distinct(), "edges")
    labels = cut_lineage(
        both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        lower = cut_lineage(lower, "labels")
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        nexts = cut_lineage(
            lower.join(jump, "low", "left").select("node", "was", F.coalesce("next", "low").alias("label")), "labels"
        )
        labels = nexts.select("node", "label")
        if nexts.filter(F.col("was") != F.col("label")).isEmpty():
            return labels
