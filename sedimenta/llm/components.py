"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.plans.scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``; the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, so long chains shorten by halves.  Labels are
    written after each round; the driver sees one number, how many have changed.
    """
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy("node").agg(F.least(F.min("v"), F.first("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("l")), "v").groupBy("node").agg(F.min("l").alias("l"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "l").alias("at"))
        jump = least.select(F.col("node").alias("at"), F.col("at").alias("component"))
        new = materialize(least.join(jump, "at").select("node", "component", "old"))
        discard(labels)
        labels = new
        if new.filter("component <> old").isEmpty():
            discard(both)
            return new
