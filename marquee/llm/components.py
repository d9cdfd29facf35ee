"""Connected components of links, as DataFrames: alternating large and small stars until nothing changes.

Every round rewrites the edges so that nodes point to smaller nodes; rounds grow with the logarithm of the longest
chain. Edges are written after each round, never collected; the driver sees a count and a checksum. A node with many
neighbours is met by a minimum with map-side aggregation, which is written, and then by a join that adaptive execution
splits: it could not, if the minimum were taken in the same stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.settle import passing, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest one around."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    least = settle(least, "least")
    moved = both.where(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. ``a`` is larger than ``b`` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, root) for every linked node but the roots; the root is the smallest node."""
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    with passing(links.sparkSession):
        edges, before = settle(edges, "edges"), None
        while True:
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == before:
                return settle(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots", keep=True)
            before = state
            edges = settle(_small_star(_large_star(edges)).distinct(), "edges")
