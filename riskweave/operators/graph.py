"""Edge scores from node vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.numbers import cosine


def lookup_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``src_vec`` and ``dst_vec`` to every edge ``(source, target, ...)``; null where a node is unknown.

    Vectors are looked up once per distinct edge and joined back, so every edge keeps its own columns and copies.
    """
    return edges.join(distinct_pairs(edges, nodes), ["source", "target"], "left")


def distinct_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct ``(source, target)`` with ``src_vec`` and ``dst_vec``: copies of a hot edge collapse before vectors move, and
    AQE splits a hot endpoint.  Nothing is broadcast by hint: node tables grow with the data."""
    pairs = edges.select("source", "target").distinct()
    src = nodes.select(F.col("id").alias("source"), F.col("vector").alias("src_vec"))
    dst = nodes.select(F.col("id").alias("target"), F.col("vector").alias("dst_vec"))
    found = pairs.join(src, "source", "left").join(dst, "target", "left")
    return found


def suspicion(a: Column, b: Column) -> Column:
    """``(1 - cos) / 2 + 1/2``; 0 where a vector is missing or zero."""
    return F.coalesce((F.lit(1.0) - cosine(a, b)) * 0.5 + 0.5, F.lit(0.0))


def graph_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``graph`` to every edge.  The score is computed per distinct edge and joined back as one double."""
    scores = distinct_pairs(edges, nodes).select("source", "target", suspicion(F.col("src_vec"), F.col("dst_vec")).alias("graph"))
    return edges.join(scores, ["source", "target"], "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))
