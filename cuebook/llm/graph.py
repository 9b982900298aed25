"""Connected components of an edge table, and joins that broadcast only counted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BROADCAST_ROWS = 2_000_000  # of a few dozen bytes each


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written, narrow table) with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node reachable.

    Each round moves every node to its smallest neighbour, if that is smaller, or on to the place
    that one moves to, and contracts the edges to the nodes moved to; a node that others moved to while it moved itself leaves an edge. So
    edges and nodes shrink from round to round, and rounds grow with the logarithm of a chain's
    length. Edges and moves are written between rounds. Aggregates combine before the shuffle;
    joins are plain joins of written tables, whose hot keys Spark may split. Rows with a null end
    are ignored."""
    links = written(_pairs(edges.select("a", "b").filter("a is not null and b is not null")), "links")
    roots = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while not links.isEmpty():
        ends = links.select(F.col("b").alias("node"), F.col("a").alias("near")).unionAll(links.select(F.col("a").alias("node"), F.col("b").alias("near")))
        step = ends.groupBy("node").agg(F.min("near").alias("to")).filter("to < node")
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moves = written(step.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "moves")
        first = moves.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        second = moves.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = links.join(first, "a", "left").join(second, "b", "left") \
            .select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        chains = moves.select(F.col("to").alias("b")).distinct().join(second, "b").select(F.col("to_b").alias("a"), "b")
        links = written(_pairs(moved.unionAll(chains)), "links")
        roots = written(roots.join(moves.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots.select("node", "root")
