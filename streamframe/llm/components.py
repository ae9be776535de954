"""Connected components by alternating large-star and small-star rounds.

Each round is two groupings with map-side combine and two joins, and its tables are
written to the shared folder, so lineage stays short. No node's neighbours are ever
gathered in one row, nor in one task where they are many. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lookup, new_path


def _written(edges: DataFrame) -> tuple[DataFrame, str]:
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path), path


def _are_stars(e: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a node that none leads from: one combined aggregate."""
    ends = e.select(F.col("u").alias("n"), "v", F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(None).cast(e.schema["v"].dataType).alias("v"), F.lit(0).alias("leaf"), F.lit(1).alias("root"))
    )
    by = ends.groupBy("n").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("leaf").alias("leaf"), F.max("root").alias("root"))
    return by.filter("low <> high OR leaf + root = 2").isEmpty()


def components(edges: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """node, component: every node that has an edge to another, and the smallest node it is connected with."""
    u, v = F.greatest(one, other), F.least(one, other)
    e, path = _written(edges.filter(F.col(one) != F.col(other)).select(u.alias("u"), v.alias("v")).distinct())
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        above = both.filter("v > u")
        low, a = _written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("c")).filter("c > 0"))
        large, b = _written(lookup(above, low, "u", "c").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least, c = _written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")))
        down = lookup(large, least, "u", "c").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        e, path = _written(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for p in (old, a, b, c):
            drop(e.sparkSession, p)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
