"""A read-through cache as a stream: hits, misses and known misses, with expiry; the first who asks builds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered

PROBE, WRITE, KNOWN_MISS = 1, 0, -1
HIT, MISS, ABSENT, BUILT = "hit", "miss", "absent", "built"


class ReadThrough(Ordered):
    """One key's entry: when it was written (null: never) and whether it says that there is nothing.

    kind of an event: PROBE, WRITE (a value), KNOWN_MISS (that there is none).  A
    probe within `ttl` of the entry is a hit, or a miss if that says so; any
    other is absent, and with `builds` the asker builds the entry then and there,
    so those who ask after it find it.  A write comes before a probe of the same moment.
    """

    fields = ("kind", "event")
    event_schema = "at long, id long, kind int, event long"
    state_schema = "written long, empty boolean"
    start = (None, False)

    def __init__(self, ttl_micros: int, builds: bool):
        self.ttl, self.builds = ttl_micros, builds
        # An entry that is past its time says nothing, so the state of an idle key may go.
        self.idle_ms = ttl_micros // 1000 + 1

    def take(self, state: tuple, event: tuple) -> tuple[tuple, tuple | None]:
        at, _, kind, number = event
        written, empty = state
        if kind != PROBE:
            return (at, kind == KNOWN_MISS), None
        if written is not None and at - written <= self.ttl:
            return state, (number, at, MISS if empty else HIT)
        if self.builds:
            return (at, False), (number, at, BUILT)
        return state, (number, at, ABSENT)

    def rows(self, key: tuple, state: tuple, results: list, settled: bool) -> Iterator[pd.DataFrame]:
        found = [r for r in results if r is not None]
        if found:
            number, at, how = zip(*found, strict=True)
            yield pd.DataFrame({"key": key[0], "id": number, "at": at, "how": how, "settled": settled})


def read_through(events: DataFrame, ttl_seconds: int, builds: bool = False, delay: str = "10 minutes") -> DataFrame:
    """Update-mode stream of key, id, at, how, settled: what each probe finds, from events (key, id, ts, kind).

    The last row of a probe holds; a settled one is the last.  Events may come late by `delay`.
    """
    rank = F.when(F.col("kind") == PROBE, F.lit(1)).otherwise(F.lit(0))
    shaped = events.withWatermark("ts", delay).select(F.col("key").cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), rank.cast("long").alias("id"), F.col("kind").cast("int").alias("kind"), F.col("id").cast("long").alias("event"))
    return shaped.groupBy("key").transformWithStateInPandas(statefulProcessor=ReadThrough(ttl_seconds * 1_000_000, builds), outputStructType="key long, id long, at long, how string, settled boolean", outputMode="Update", timeMode="EventTime")


def last_found(rows: DataFrame) -> DataFrame:
    """key, id, at, how: the last row of each probe of a drained stream."""
    return rows.groupBy("key", "id").agg(F.max_by(F.struct("at", "how"), F.struct("batch", "settled")).alias("x")).select("key", "id", "x.at", "x.how")
