"""Fingerprints of documents, and of a whole corpus by a hash tree that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf that the depth of a tree aims at.
LEAF_ROWS = 1024


def document_fingerprints(hashes: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint): SHA-256 of a document's sorted hashes, one a line."""
    return hashes.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), "\n"), 256).alias("fingerprint"))


def tree_depth(rows: int) -> int:
    """Levels of a tree of 16 branches whose leaves have LEAF_ROWS rows or fewer, on average."""
    depth = 0
    while rows > LEAF_ROWS * 16**depth:
        depth += 1
    return depth


def hash_tree(hashes: DataFrame, depth: int) -> DataFrame:
    """(prefix, digest) of all nodes of a tree over a multiset of hexadecimal hashes; the root's prefix is empty.

    Leaves are the ranges of hashes with the same first depth digits: the SHA-256 of their distinct hashes in order, each
    with its number, so copies, however many, are one line that is summed before the shuffle. A node above has up to 16
    children and is the SHA-256 of their prefixes and digests. An empty corpus has no nodes.
    """
    counted = hashes.groupBy("hash").agg(F.count("*").alias("n"))
    line = F.struct("hash", F.concat_ws(":", "hash", F.col("n").cast("string")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    level = counted.groupBy(F.substring("hash", 1, depth).alias("prefix")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
    return _above(level, depth)


def _above(level: DataFrame, depth: int) -> DataFrame:
    tree = level
    for d in range(depth - 1, -1, -1):
        child = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"]))
        level = level.groupBy(F.substring("prefix", 1, d).alias("_up")).agg(F.sha2(F.array_join(child, "\n"), 256).alias("digest")).select(F.col("_up").alias("prefix"), "digest")
        tree = tree.unionByName(level)
    return tree


def updated_tree(tree: DataFrame, hashes: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """The tree of hashes, of which only those of changed (hash) differ from what tree was made of: leaves without a changed
    hash are kept, the others are made anew from their rows."""
    touched = changed.select(F.substring("hash", 1, depth).alias("prefix")).distinct()
    rows = hashes.withColumn("prefix", F.substring("hash", 1, depth)).join(touched, "prefix", "left_semi").select("hash")
    fresh = hash_tree(rows, depth).where(F.length("prefix") == depth)
    kept = tree.where(F.length("prefix") == depth).join(touched, "prefix", "left_anti")
    return _above(kept.unionByName(fresh), depth)
