"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b); nodes without a link to another don't appear.

    Alternates large-star and small-star steps until the links no longer change.  Each step is one grouped minimum (partial
    aggregation first, so a hot node costs little) and one join, and is written to the shared folder.
    """
    both = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(both)  # a < b
    last = None
    while True:
        turned = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = turned.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of every node move to its smallest neighbour
        large = turned.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: every node and its smaller neighbours move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select("m", "b"))
        edges = cut(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        last = mark
