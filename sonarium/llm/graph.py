"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.session import materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` for every end of ``edges(a, b)``; ``label`` is one node of the component.

    Each round hangs every node on its smallest neighbour and joins nodes that hang together. Node numbers should be
    hash values: in random order a round removes a constant share of the nodes, whatever the shape of the graph.
    Rounds write their small tables to the shared work folder. Hubs are aggregated before they are shuffled, and their
    edges meet in joins that adaptive execution can split. Null ends and loops are ignored; no edges, no rows.
    """
    spark = edges.sparkSession
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hung = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), name)
        rounds.append(hung)
        left = hung.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = hung.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = materialize(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    if not rounds:
        return spark.createDataFrame([], "node bigint, label bigint")
    labels = rounds.pop()
    while rounds:
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = rounds.pop().join(upper, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return labels
