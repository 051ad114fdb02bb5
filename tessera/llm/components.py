"""Connected components by hooking roots and pointer jumping, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, spread_join


def tops(rows: DataFrame, up: DataFrame) -> DataFrame:
    """(label, top): the label that up gives to each label of rows, if any."""
    return rows.select("label").distinct().join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label")


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label) for every node with an edge; label is the least node of its component.

    Each round hooks every root to its least smaller neighbour (a map-side minimum), lets pointers jump to the new
    roots and draws the edges between those, without the edges inside a tree. A root that neither hooks nor is hooked
    to has a smaller neighbour in the next round, so two rounds halve the roots of a component at least, whatever its
    shape; the loop ends where no edge is left. Every round ends in written tables.
    """
    pairs = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct()
    pairs, labels = materialise(pairs, "edges"), None
    while not pairs.isEmpty():
        up = materialise(pairs.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label"), "hooks")
        while True:
            step = materialise(spread_join(up, tops(up, up), "label", "node", how="left").select("node", F.coalesce("top", "label").alias("label"), F.col("top").isNotNull().alias("moved")), "hooks")
            up = step.select("node", "label")
            if step.where("moved").isEmpty():
                break
        root = lambda s: up.select(F.col("node").alias(s), F.col("label").alias(f"r_{s}"))
        pairs = pairs.join(root("b"), "b").join(root("a"), "a", "left").select(F.coalesce("r_a", "a").alias("x"), F.col("r_b").alias("y"))
        pairs = materialise(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        if labels is not None:
            up = materialise(spread_join(labels, tops(labels, up), "label", "node", how="left").select("node", F.coalesce("top", "label").alias("label")).unionByName(up), "labels")
        labels = up
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select("label").distinct().select(F.col("label").alias("node"), "label"))
