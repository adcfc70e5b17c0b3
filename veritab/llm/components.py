"""Connected components of a graph of any size, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (a, b: long) with their component's smallest node.

    Returns node, component for every node with an edge to another one. In each round a node
    moves to the first of itself and its neighbours - by number in the first round, so that
    stars around their smallest node collapse at once, then in another random order each
    round, so that long chains shrink by a constant share - and the graph of the places is
    next. Every round ends in a written table.
    """
    edges = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels: DataFrame | None = None
    rounds = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = F.col("b") if rounds == 0 else F.xxhash64("b", F.lit(rounds))
        own = F.col("a") if rounds == 0 else F.xxhash64("a", F.lit(rounds))
        nearest = both.withColumn("place", place).groupBy("a").agg(F.min("place").alias("place"), F.min_by("b", "place").alias("to"))
        moved = nearest.select(F.col("a").alias("node"), F.when(own <= F.col("place"), F.col("a")).otherwise(F.col("to")).alias("component"))
        moved = materialize(moved, "moved")
        from_a = moved.select(F.col("node").alias("a"), F.col("component").alias("x"))
        from_b = moved.select(F.col("node").alias("b"), F.col("component").alias("y"))
        contracted = edges.join(from_a, "a").join(from_b, "b").where("x != y")
        edges = materialize(contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = moved
        else:
            step = moved.select(F.col("node").alias("component"), F.col("component").alias("next"))
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        rounds += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    smallest = materialize(labels.groupBy("component").agg(F.min("node").alias("smallest")), "smallest")
    return labels.join(smallest, "component").select("node", F.col("smallest").alias("component"))
