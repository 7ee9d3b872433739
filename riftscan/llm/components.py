"""Connected components of an edge table, by alternating large and small stars.

Each round joins an edge table with its nodes' smallest neighbours, so work
and shuffles are in proportion to the edges, hubs are split by the engine's
skew handling, and nothing is gathered in one place. Rounds grow with the
logarithm of a component's diameter; each is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftscan.llm.base import cut


def _least(edges: DataFrame, node: str, name: str) -> DataFrame:
    """The smallest neighbour below each node that has one.

    Grouping by the node and a constant function of it leaves the result
    partitioned by both, so that a join on the node shuffles it anew; only
    then does adaptive execution split the other side's hot partitions.
    """
    return edges.groupBy(F.col("a").alias(node), F.pmod("a", F.lit(1)).alias("z")).agg(F.min("b").alias(name)).drop("z")


def _large(edges: DataFrame) -> DataFrame:
    """``edges`` are (larger, smaller). Each larger one moves to the smallest neighbour of its smaller one."""
    least = _least(edges, "node", "m")
    return edges.join(least, edges["b"] == least["node"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """All smaller neighbours of a node, and the node itself, move to the smallest."""
    least = _least(edges, "node", "m")
    moved = edges.join(least, edges["a"] == least["node"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has an edge in (a, b)."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    state = None
    while True:
        edges = cut(_small(_large(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
