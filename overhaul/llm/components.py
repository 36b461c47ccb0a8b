"""Connected components of a graph given as edges, in rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overhaul.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; edges have ``a`` and ``b`` (long).

    Every round, each node takes the smallest label among its neighbours, and
    then the label of its label, so labels travel twice as far in every round.
    Each round is written to the shared folder. A node with very many edges
    is read in pieces (the minimum is taken before the shuffle, and the join
    with the labels, unique by node, can be split).
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                   .select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        better = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = stage(better.join(jump, "component", "left").select(
            "node", "before", F.least("component", "further").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("before <> component").isEmpty():
            return labels
