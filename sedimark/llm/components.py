"""Connected components of a link table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least of them; a logarithmic number
    of rounds leaves stars.  The minimum is taken with a partial aggregate before the shuffle, so a hub costs one row a
    task there.  Every round is materialised in the shared folder.  Links from a node to itself and nulls are left out.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        edges = cut(small.select("a", F.col("m").alias("b")).unionByName(small.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(a.alias("node"), b.alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
