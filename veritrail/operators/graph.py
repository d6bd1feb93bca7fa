"""Connected components in DataFrames, for nodes of any sortable type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.plans.session import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of each component of edges (a, b).

    Every round each node points at its least neighbour, pointers are followed once, and the
    graph shrinks to the nodes pointed at. Rounds are cut by written tables, so lineage stays short.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = written(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    left = both.where("a <> b")
    while not left.isEmpty():
        up = written(left.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")))
        up = written(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", F.coalesce("q", "p").alias("p")))
        labels = written(labels.join(up.select(F.col("a").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        left = left.join(up.select("a", F.col("p").alias("pa")), "a").join(up.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        left = written(left.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return labels
