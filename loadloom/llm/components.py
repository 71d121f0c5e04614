"""Connected components of a link table, by alternating stars.

Each round sends, from every node, its larger neighbours (then its smaller ones) to the least
node of its neighbourhood. A node of very many links is a group only where its links meet;
sums are partial there, and no group is gathered. Rounds end when every node hangs from a root that hangs from none, after
a number of them that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node with a link in (``a``, ``b``)."""
    edges = shelf.put(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        ends = edges.select(F.col("a").alias("x"), F.lit(0).alias("below")).union(edges.select(F.col("b").alias("x"), F.lit(1).alias("below")))
        torn = ends.groupBy("x").agg(F.sum("below").alias("below"), F.min("below").alias("above")).where("below > 1 or below = 1 and above = 0")
        if torn.isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # Small star: from each node to the least of its smaller neighbours and itself.
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u")
        out = small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b")
        edges = shelf.put(out.distinct(), "stars")
