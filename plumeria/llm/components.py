"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.session import cut_lineage


def _around(edges: DataFrame) -> DataFrame:
    """u, v, least: every edge with the least node among u and its neighbours.

    The least is summed up before the shuffle, and the join back can be split, so a node
    with very many neighbours is no single task's work.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    """A digest of the edge set: their number and a sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """u, v -> node, component: the least node that can be reached, for every node with an edge.

    Edges count in both directions; repeated edges, loops and edges with a null end are ignored.
    Every round is written to the checkpoint folder. Rounds grow with the logarithm of the
    number of nodes.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut_lineage(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _around(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        around = _around(large)
        small = around.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = small.unionByName(around.select("u", F.col("least").alias("v"))).distinct()
        edges = cut_lineage(small)
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
