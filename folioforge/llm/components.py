"""Connected components by alternating large-star and small-star steps, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the (larger, or smaller-or-equal) neighbours of each node at its least neighbour."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    if not large:
        both = both.filter("m < n")
    least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
    near = both.filter("m > n") if large else both
    moved = near.join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("n").alias("a"), F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long): component is the least node reachable.

    Stops when a round changes no edge. Nulls and loops link nothing.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == state:
            break
        state = tuple(mark)
        now = checkpointed(_star(_star(now, True), False))
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)
