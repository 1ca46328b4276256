"""Refresh of stale records in waves: authors, then their books, then these books' chapters, by region.

A wave holds what is stale of its kind and what hangs on the records that the
wave before refreshed; nothing is visited twice.  A record that fails stays in
its wave, marked, and what hangs on it alone waits for the next time.  Within a
wave and region records go oldest first, `quota` at a time: their rounds and
slots.  Places within a region are counted over ranges of it, so a region that
holds most records is no one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .scan import Ranges
from .store import stale

DAYS, QUOTA = 7, 5
KINDS = ("author", "book", "chapter")


def waves(records: dict[str, DataFrame], links: dict[str, DataFrame], now: Column, days: float = DAYS) -> DataFrame:
    """kind, id, region, updated_at, wave, cause (stale, or parent), failed of all that is to be refreshed.

    records: for each kind id, region, updated_at (null: never), failed (whether
    its refresh fails); links: for each kind but the first parent, id.
    """
    frontier, out = None, None
    for wave, kind in enumerate(k for k in KINDS if k in records):
        due = F.coalesce(stale(F.col("updated_at"), now, days), F.lit(True))
        own = records[kind].filter("id IS NOT NULL")
        found = own.filter(due).withColumn("cause", F.lit("stale"))
        if frontier is not None:
            # What is due anyway isn't visited again for its parent's sake: only the rest meets what hangs on the wave before.
            hanging = links[kind].join(frontier.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id")
            found = found.unionByName(own.filter(~due).join(hanging, "id", "left_semi").withColumn("cause", F.lit("parent")))
        found = found.select(F.lit(kind).alias("kind"), "id", "region", "updated_at", F.lit(wave).alias("wave"), "cause", F.coalesce("failed", F.lit(False)).alias("failed"))
        found = cut_lineage(found)
        frontier = found.filter("NOT failed").select("id")
        out = found if out is None else out.unionByName(found)
    return out


def scheduled(work: DataFrame, quota: int = QUOTA) -> DataFrame:
    """work with round and slot (0 to quota - 1): the oldest of each wave and region first, those never updated before all."""
    keyed = work.withColumn("_at", F.coalesce(F.unix_micros("updated_at"), F.lit(-(1 << 62)))).withColumn("_key", F.concat_ws("/", F.col("wave").cast("string"), F.coalesce("region", F.lit(""))))
    placed = Ranges(keyed, "_key", ["_at", "id"]).numbered("_place")
    n = F.col("_place") - 1
    return placed.select(*work.columns, F.floor(n / quota).cast("long").alias("round"), (n % quota).cast("int").alias("slot"))


def summary(plan: DataFrame) -> DataFrame:
    """Of each wave and region: how many records, how many succeed and fail, and how many rounds they take."""
    return plan.groupBy("wave", "kind", "region").agg(F.count("*").alias("total"), F.count_if(~F.col("failed")).alias("success"), F.count_if("failed").alias("failures"), (F.max("round") + 1).alias("rounds"))
