"""Connected components of a table of edges by alternating star steps, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from subsumo.session import materialize


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Points the neighbours of each node (all larger ones, or all smaller ones) to the smallest."""
    if both_ways:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
    met = near.join(least, "u")
    if both_ways:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("root").alias("v"))
    else:
        own = least.select("u", F.col("root").alias("v"))
        out = met.select(F.col("v").alias("u"), F.col("root").alias("v")).unionByName(own)
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and comp (the smallest node it is connected with) for every node of an edge (u, v)."""
    edges = materialize(edges.select("u", "v").where("u <> v"))
    before = None
    for _ in range(rounds):
        seen = Observation()
        total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("total")
        stars = _stars(_stars(edges, True), False).observe(seen, F.count(F.lit(1)).alias("n"), total)
        edges = materialize(stars)
        state = (seen.get["n"], seen.get["total"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots).distinct()
