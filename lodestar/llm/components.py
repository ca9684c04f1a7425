"""Connected components of an edge table, as joins: nothing is collected, lineage is cut with written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .joins import spread_join


def jump(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by its root; parents never form a cycle. A hub that is the parent of a
    third of all nodes is spread."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        moved = F.col("above").isNotNull() & (F.col("above") != F.col("parent"))
        joined = materialise(spread_join(parents, up, "parent", "node", "left").select("node", F.coalesce("above", "parent").alias("parent"), moved.alias("moved")), "jump")
        parents = joined.select("node", "parent")
        if joined.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in edges (a, b); the root is a node of the component. Every round each node points to
    its least neighbour, pointers are followed to their roots, and the edges are contracted to roots; a hub with a third
    of all edges is aggregated on the map side and spread in the joins. Rounds grow with the logarithm of the input."""
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = jump(materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent")), "parents"))
        at_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        at_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        half = materialise(spread_join(edges, at_a, "a", "b"), "edges")
        between = spread_join(half, at_b, "b", "a").where("ra <> rb")
        edges = materialise(between.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            up = parents.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            roots = materialise(spread_join(roots, up, "root", "node", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
