"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges; a vertex with very
many neighbours is reduced by partial aggregation and joined with skew
splitting, so no task holds a neighbourhood.  Lineage is cut by a table in the
shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: str, rounds: int = 60) -> DataFrame:
    """node, component (the least node it reaches) for every node of edges (u, v), u != v; no row for lone nodes."""
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), f"{work}/edges-0")
    mark = None
    for r in range(1, rounds + 1):
        edges = written(_small_star(_large_star(edges)), f"{work}/edges-{r}")
        if r > 1:
            remove(spark, f"{work}/edges-{r - 2}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
