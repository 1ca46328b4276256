"""Connected components: of records that share keys, and of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage


def _hang_greater(edges: DataFrame) -> DataFrame:
    """Each vertex hangs its greater neighbours on the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    moved = both.filter("v > u").join(least, "u").filter("v != least")
    return moved.select(F.col("v").alias("u"), F.col("least").alias("v"))


def _hang_smaller(edges: DataFrame) -> DataFrame:
    """Each vertex hangs itself and its other smaller neighbours on the least of them; edges lead down."""
    down = edges.distinct()
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.withColumnRenamed("least", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) of every node of edges (u, v).

    Both steps in turn make stars within rounds that grow with the logarithm of
    a component's size, not with its length.  Neighbourhoods are only ever
    aggregated and joined, so none has to fit in a task; each round is a table.
    """
    edges = cut_lineage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        edges = cut_lineage(_hang_smaller(_hang_greater(edges)))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def key_components(df: DataFrame, node: str, keys: str) -> DataFrame:
    """node, component (least node reached) where nodes meet through any of their `keys`; a node without keys is its own.

    Nodes of a key are linked with the least of them, so a key that very many
    nodes hold is never expanded into pairs.
    """
    held = cut_lineage(df.select(F.col(node).alias("node"), F.explode_outer(keys).alias("key")).distinct())
    known = held.filter("key IS NOT NULL")
    least = known.groupBy("key").agg(F.min("node").alias("least"))
    found = components(known.join(least, "key").select(F.col("node").alias("u"), F.col("least").alias("v")))
    return held.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
