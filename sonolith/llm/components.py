"""Connected components as a distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    `edges` has long columns `a` and `b`; loops and repeated rows are allowed. Each round
    hooks the larger neighbours of a node on its smallest one (large star) and then does the
    same for the smaller side (small star), so that path lengths shrink geometrically. Both
    are a grouped minimum, which combines before the shuffle, and a join on the node, whose
    large partitions adaptive execution splits. Only a count and a checksum reach the driver.

    Returns (node, component), one row for each node with an edge to another; no rows
    for an empty edge table.
    """
    cur = materialise(_canonical(edges), "cc")
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every neighbour above the node goes to the smallest of its neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _canonical(large)
        # small star: the node and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("a"), F.col("b"), F.col("m"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        cur = materialise(_canonical(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))), "cc")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(cur.select(F.col("a"), F.col("a")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
