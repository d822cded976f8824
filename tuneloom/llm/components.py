"""Connected components of links between numbered nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tuneloom.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(lowest, "a").filter("b > a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them; ``a > b`` in every link."""
    lowest = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.withColumnRenamed("m", "b")).distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` but the roots; a root is the smallest node of its component.

    Every round is written to the shared folder; the rounds grow with the logarithm of the longest chain.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while (digest := _digest(links)) != last:
        last = digest
        links = stored(_small_star(_large_star(links)), "links")
    # Now every link leads from a node to its root.
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
