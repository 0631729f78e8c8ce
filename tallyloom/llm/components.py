"""Connected components by alternating large-star and small-star steps, each a Spark job on a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import common


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node points at the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, point at the least neighbour. Edges run from u down to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b) that is not itself the least of its component.

    Each round is written to the shared folder; rounds end when the edge table no longer changes, after about the
    logarithm of the longest path. No list of neighbours is ever gathered.
    """
    first = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.staged(first, "edges")
    state = _state(edges)
    while state[0]:
        large = common.staged(_large_star(edges), "edges")
        small = common.staged(_small_star(large), "edges")
        common.discard(edges, large)
        edges, before, state = small, state, _state(small)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
