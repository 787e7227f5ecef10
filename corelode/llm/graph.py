"""Connected components of a link table, as Spark joins.

Alternating stars: each round points every vertex at the smallest vertex that it knows (first over its larger
neighbours, then over its smaller ones) until all edges are (vertex, smallest vertex of its component). A star of any
size is a fixed point, so hot vertices cost one join row per link and no vertex's links are ever gathered. A row of these joins is two
numbers, so a hub is a matter of megabytes until it has many millions of links, from where on adaptive execution splits its partition of the
(inner) join. Rounds are written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written

#: Rounds after which something must be wrong (their number grows with the logarithm of the longest path).
MOST_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One round: edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # now over the smaller neighbours: v < u in every row
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex points at one other that points at none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every vertex of the links (a, b); component is the smallest id reachable."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        edges = written(_stars(edges), "edges")
    raise RuntimeError("components did not settle")
