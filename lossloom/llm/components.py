"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import join_sized
from lossloom.sources.store import cut_lineage


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Every node hands the least of itself and its neighbours to its larger neighbours. Edges go from the larger node u to the smaller v.

    The root of a large group has very many neighbours; such few nodes are joined through a broadcast table.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "_m").alias("_m"), "_n")
    return join_sized(both.where("v > u"), cut_lineage(least, name), "u", "_n").select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its least smaller neighbour to itself and to its other smaller neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    others = edges.join(least, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return others.unionByName(least.select("u", F.col("_m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root or the child of exactly one root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    seen = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return seen.where("child > 1 OR (child = 1 AND root = 1)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, root) for every node that occurs in ``edges`` (u, v: bigint); the root is the least node of its component. Each round is a stored table."""
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _settled(edges):
        edges = cut_lineage(_small_star(_large_star(edges, name)).distinct(), name)
    roots = edges.select("v").distinct().select(F.col("v").alias("u"), F.col("v").alias("root"))
    return edges.select("u", F.col("v").alias("root")).unionByName(roots)
