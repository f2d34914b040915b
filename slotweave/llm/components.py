"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import checkpoint, drop_tables, in_few

#: Bytes of an edge.
EDGE = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Re-hang each node's larger (or smaller) neighbours on its smallest neighbour."""
    e = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = e.join(least, "a")
    hung = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hung.filter("a <> b")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``links`` (a, b).

    ``component`` is the smallest node of the component.  A round costs joins
    linear in the edges and every path at least halves, so rounds grow with the
    logarithm of the longest path; each round is cut by a checkpoint, and none has
    more edges than the one before.  Links of a
    node with itself, repeated ones, and links with a null end say nothing; no
    links give no rows.
    """
    size = links.count() * EDGE
    edges = checkpoint(in_few(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), size))
    while True:
        before, edges = edges, checkpoint(in_few(_star(_star(edges, True), False).distinct(), size))
        drop_tables(before)
        # a forest of stars is done: no node hangs on two others, or has others hanging on it while it hangs itself
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1")
        if odd.isEmpty():
            break
    children = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    roots = children.select(F.col("component").alias("node"), F.col("component")).distinct()
    return children.union(roots)
