"""Distributed union-find: connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of `edges` reaches; nodes without an edge are absent.

    Each round points every node at its smallest neighbour, halves the paths of these pointers until they end, and
    contracts the edges to the ends; only edges between different ends go on, so the table shrinks geometrically and a
    star is done in one round. Loops and repeated edges are allowed; no edges give no rows. Every round is stored, so
    a lost executor costs no more than the round.
    """
    left = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    roots: DataFrame | None = None
    while left.limit(1).count():
        both = left.union(left.select("b", "a")).toDF("node", "other")
        pointer = stored(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        while True:
            ends = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = stored(pointer.join(ends, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            pointer = further.select("node", "root")
            if not further.where("moved").limit(1).count():
                break
        roots = pointer if roots is None else followed(roots, pointer)
        left = stored(
            left.join(pointer.toDF("a", "x"), "a").join(pointer.toDF("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def followed(roots: DataFrame, pointer: DataFrame) -> DataFrame:
    """`roots` after `pointer` (node, root) has joined some of its roots, with the nodes that only `pointer` has."""
    moved = roots.join(pointer.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored(moved.unionByName(pointer.join(roots.select("node"), "node", "left_anti").select("node", "root")))
