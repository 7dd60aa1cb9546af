"""Connected components of an edge list, by alternating star operations."""

from pyspark.sql import DataFrame, functions as F

from lorebase.llm.common import spread_join
from lorebase.sources.scratch import kept

#: Links of one node that a task takes at least: rows of two numbers.
SHARE = 10_000


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to its least neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return spread_join(both.filter("b > a"), least, "a", least=SHARE).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = spread_join(down, least, "a", least=SHARE).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node reachable, for every node of ``edges`` (a, b).

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    e = kept(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        e = kept(_small_star(_large_star(e)).filter("a <> b").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now
