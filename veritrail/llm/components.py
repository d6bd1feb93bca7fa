"""Connected components by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the least node of its component.

    Each round points every node at its least neighbour, follows pointers once more, and
    replaces the edges by those between the nodes pointed at, so the graph shrinks by a
    factor. Every round is written, so no lineage grows. Null nodes are not nodes.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "cc-labels")
    left = both.where("a <> b")
    while left.limit(1).count():
        parent = materialize(left.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "cc-parents")
        hop = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = materialize(parent.join(hop, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "cc-parents")
        labels = materialize(
            labels.join(parent.select(F.col("a").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "cc-labels"
        )
        from_ = parent.select("a", F.col("p").alias("pa"))
        to = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        left = left.join(from_, "a").join(to, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        left = materialize(left, "cc-edges")
    return labels
