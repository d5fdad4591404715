"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step groups edges by node and keeps the smallest neighbour, so only minima are combined and no neighbourhood is
collected; the number of steps grows with the logarithm of the longest path. Steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import stored, tight


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (large) or not larger neighbours to the smallest of all."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node with an outgoing edge has only one, to a node that has none."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))
    )
    odd = ends.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.count_if(F.col("to").isNull()).alias("n"))
    return odd.where("a <> b OR (a IS NOT NULL AND n > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge to another; edges are (u, v)."""
    edges = tight(stored(_star(edges.select("u", "v").where("u <> v"), False)))
    while not _is_star_forest(edges):
        edges = tight(stored(_star(_star(edges, True), False)))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
