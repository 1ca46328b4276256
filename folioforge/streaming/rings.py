"""Rings of the newest rows of a key as mergeable state: what the last n were, however the stream cuts them into batches."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Shards of a key: a hot key's rows are dealt over so many rings, whose newest are merged.
SHARDS = 8


class Ring(StatefulProcessor):
    """The newest `size` rows (at, id, value) of a key and shard, by time and then id, and how many there were.

    A batch is read through; no more than a ring and an Arrow batch is held.  The
    newest of a ring and a batch are the newest of all, so order doesn't matter.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "at long, id long, value double")
        self.count = handle.getValueState("count", "n long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.count.get()[0] if self.count.exists() else 0
        held = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        for part in rows:
            seen += len(part)
            # A null value is none, not NaN, so that rows can be ordered.
            fresh = zip(part["at"].tolist(), part["id"].tolist(), (None if pd.isna(v) else v for v in part["value"].tolist()), strict=True)
            held = heapq.nlargest(self.size, chain(held, fresh), key=lambda r: r[:2])
        self.count.update((seen,))
        self.ring.put(held)
        at, number, value = zip(*held, strict=True)
        yield pd.DataFrame({"key": key[0], "shard": pd.array([key[1]] * len(held), "int32"), "seen": seen, "at": at, "id": number, "value": value})


def rings(events: DataFrame, size: int, shards: int = SHARDS) -> DataFrame:
    """Update-mode stream of key, shard, seen, at, id, value: each ring as it is after each batch, from events (key, ts, id, value)."""
    shaped = events.select(F.col("key").cast("string").alias("key"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    return shaped.groupBy("key", "shard").transformWithStateInPandas(statefulProcessor=Ring(size), outputStructType="key string, shard int, seen long, at long, id long, value double", outputMode="Update", timeMode="None")


def newest(df: DataFrame, key: list[str], order: list[Column], size: int) -> DataFrame:
    """The newest `size` rows of each key; Spark cuts each task's part down to as many before they are dealt."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= size).drop("_r")


def merged(rows: DataFrame, size: int) -> DataFrame:
    """key, seen, at, id, value: the rings of a drained stream as they were last, their shards merged."""
    last = rows.groupBy("key", "shard").agg(F.max("batch").alias("batch"))
    now = rows.join(last, ["key", "shard", "batch"])
    seen = now.groupBy("key", "shard").agg(F.max("seen").alias("seen")).groupBy("key").agg(F.sum("seen").alias("seen"))
    return newest(now.select("key", "at", "id", "value"), ["key"], [F.desc("at"), F.desc("id")], size).join(seen, "key")
