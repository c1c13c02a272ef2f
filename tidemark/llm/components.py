"""Connected components of a link table by alternating large-star and small-star steps, every round written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b: bigint, not null); root is the least node reachable.

    Each round joins every node with the least of its neighbours; minima are formed map-side, and a node with very many
    neighbours only costs its rows, which the join may split. Links shrink to stars; rounds grow with the logarithm of the
    longest chain. An empty table gives an empty table.
    """
    spark = links.sparkSession
    mark = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    stars = written(_small_star(links.where("a <> b")), "links")
    was = mark(stars)
    while was[0]:
        new = written(_small_star(_large_star(stars)), "links")
        dropped(spark, stars)
        stars, before, was = new, was, mark(new)
        if was == before:  # the links are distinct, so equal marks mean equal links
            break
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    """Links from a node's greater neighbours to the least of it and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links from a node and its lesser neighbours to the least of them; a is always the greater end."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
