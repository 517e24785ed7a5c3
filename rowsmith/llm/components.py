"""Connected components of a graph of links, as joins and groupings.

Large-star and small-star steps take turns: each node's larger neighbours are hung on its smallest one,
then each node's smaller neighbours are. Rounds grow with the logarithm of the longest path. Every
grouping is a minimum (added up before the shuffle) and every join is one that adaptive execution can split, so a
node with very many links is no single task's work. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import saved


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` of every node that has a link to another; component is its smallest node."""
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    edges = saved(edges.filter("a != b").distinct(), "links")
    before = _fingerprint(edges)
    while before[0]:
        edges = saved(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
