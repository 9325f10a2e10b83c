"""Connected components of a graph whose nodes are 64-bit numbers, without gathering it anywhere."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Large-star and small-star steps in turn: each points a node's neighbours to the least of them, so a component of
    diameter d is a star after about log d rounds, and no round makes more edges than nodes and edges there were. Each
    round is written to the shared folder. A node with very many neighbours is joined, not collected, so no task holds them all.
    Repeated edges and both directions of one count once; an edge from a node to itself or to null gives no row, and neither does
    an empty table. Nodes without edges are the caller's.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = ws.write(e, f"{name}-0")
    for i in count(1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        # small star: of edges to smaller nodes, all but the least move to it
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        after = ws.write(small, f"{name}-{i}")
        # a star: every node points to one that points nowhere
        moved = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() or after.groupBy("a").count().where("count > 1").limit(1).count()
        ws.drop(f"{name}-{i - 1}")
        now = after
        if not moved:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
