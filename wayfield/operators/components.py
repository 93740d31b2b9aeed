"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.session import discard, materialize


def _roots(edges: DataFrame) -> DataFrame:
    """(u, m): the least smaller neighbour of every node that has one; edges are (u, v) with u > v."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _beside(edges: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    """Edges with the root of one end, null where it has none. The second key asks for exchanges right below the join, of
    which Spark can split those of a hub."""
    keyed = edges.withColumn("k", F.col(end).bitwiseAND(1023))
    return keyed.join(roots.select(F.col("u").alias(end), F.col("u").bitwiseAND(1023).alias("k"), "m"), [end, "k"], "left")


def _stars(edges: DataFrame) -> DataFrame:
    """A large star, then a small one. In a large star the larger end of an edge moves to the root of the smaller end, which
    stays its own where it has none; so a hub that is the least of its neighbours is not touched."""
    large = _beside(edges, _roots(edges), "v").select("u", F.coalesce("m", "v").alias("v")).distinct()
    roots = _roots(large)
    moved = _beside(large, roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(roots.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars about the least node of each component: no node has two roots, no root has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("roots"), F.min("up").alias("least"))
    return not nodes.agg(F.coalesce(F.max(F.expr("roots > 1 OR (roots = 1 AND least = 0)")), F.lit(False))).first()[0]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) can reach. Nodes are longs.

    Each round is written to the shared folder; nothing but whether it was the last one comes to the
    driver. The stars of a component of n nodes settle in O(log n) rounds; edges that are stars already need none.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        after = materialize(_stars(now), "stars")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
