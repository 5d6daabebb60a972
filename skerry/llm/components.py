"""Connected components as DataFrames: alternating large-star and small-star steps.

Every step is two aggregations over the edges with map-side combining; nothing but one
counter per step comes to the driver.  Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) in both directions.  Links u's neighbours to the least id that u knows."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    both = edges.join(least, "u")
    if large:
        return both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    kept = both.filter(F.col("v") < F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return kept.union(least.filter(F.col("_m") < F.col("u")).select("u", F.col("_m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v), component being the least node reachable.

    Self links, repeated links and either direction are allowed; rows holding a null are ignored.
    An empty input gives an empty result.
    """
    forest = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    forest = materialize(forest, "edges")
    before = None
    while True:
        both = forest.union(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, large=True).filter("u > v").distinct()
        both = wide.union(wide.select(F.col("v").alias("u"), F.col("u").alias("v")))
        forest = materialize(_star(both, large=False).filter("u > v").distinct(), "edges")
        # A forest of stars does not change: each node has one link, to a node that has none upwards.
        sign = forest.agg(F.count("*"), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before:
            break
        before = sign
    heads = forest.select(F.col("v").alias("node")).distinct()
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.select("node", F.col("node").alias("component")))
