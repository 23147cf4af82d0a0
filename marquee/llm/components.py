"""Connected components by joins, with the lineage cut at each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import discard, materialize


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node it can reach.

    Each round, every node of the remaining edges takes the smallest of itself and its neighbours
    as parent, two pointer jumps shorten the chains of parents, and the edges are replaced by those
    between parents. Chains shrink by a constant factor a round. Aggregates combine on the map side,
    so a node with very many edges is no hot key; nothing is collected. Loops and repeated edges are
    ignored; an empty table gives an empty table.
    """
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    left = materialize(pair, "edges")
    labels = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        first = parent = materialize(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parent = parent.join(up, "parent").select("node", F.col("above").alias("parent"))
        parent = materialize(parent, "parents")
        moved = labels.join(parent.select(F.col("node").alias("label"), "parent"), "label", "left")
        before, labels = labels, materialize(moved.select("node", F.coalesce("parent", "label").alias("label")), "labels")
        a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        pair = left.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges_before, left = left, materialize(pair.filter("a < b").distinct(), "edges")
        discard(first, parent, before, edges_before)
    discard(left)
    return labels
