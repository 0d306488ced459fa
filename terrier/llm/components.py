"""Connected components of a graph given as edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (both.join(least, "a").filter("b > a AND b <> least")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    kept = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(kept).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: each node that has an edge to a smaller root, with the least node it reaches.

    ``edges`` has ``a`` and ``b`` of one type. Loops, repeated and reversed edges add
    nothing; edges with a null end are left out. Roots themselves and nodes without
    edges are not listed. Each round is written to the shared folder, so a lost
    executor costs the round at most; the number of rounds grows with the logarithm
    of the nodes. Two numbers a round come to the driver.
    """
    now = staged(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = staged(_small_star(_large_star(now)))
