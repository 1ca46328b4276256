"""Circuit breaker per key: a stateful stream operator and its batch twin.

Closed: failures count up (successes don't clear them) and the fifth opens it.
Open: calls are rejected for a minute, then it is half open with counters
cleared.  Half open: two successes close it, any failure opens it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered

#: Failures that open it, how long, successes that close it.
FAILURES, OPEN_MICROS, SUCCESSES = 5, 60_000_000, 2
CLOSED, OPEN, HALF = 0, 1, 2
START = (CLOSED, 0, 0, 0, 0, 0)
FOLDED = "calls long, rejected long, trips long, mode int"


def fold(events: DataFrame, key: str, ts: str, order: str, failed: Column) -> DataFrame:
    """key, calls, rejected, trips, mode at the end: each key's calls in order.

    Calls are dealt by key, sorted, and read once; of a key only its state is
    held, so a key of very many calls is no more than a long run.
    """
    calls = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(ts).alias("at"), F.col(order).alias("o"), failed.alias("failed"))
    dealt = calls.repartition("key").sortWithinPartitions("key", "at", "o")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, n, state, begun = None, 0, START, False
        for batch in batches:
            done: list[tuple] = []
            for k, at, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not begun or k != open_:
                    if begun:
                        done.append((open_, n, state[4], state[5], state[0]))
                    open_, n, state, begun = k, 0, START, True
                state = advance(state, at, bad)
                n += 1
            yield _folded(done)
        yield _folded([(open_, n, state[4], state[5], state[0])] if begun else [])

    return dealt.mapInArrow(step, f"key long, {FOLDED}").withColumnRenamed("key", key)


def _folded(rows: list[tuple]) -> pa.RecordBatch:
    names = ("key", "calls", "rejected", "trips", "mode")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if c == "mode" else pa.int64()) for i, c in enumerate(names)], names=list(names))


def advance(state: tuple, at: int, failed: bool) -> tuple:
    """The state (mode, failures, successes, opened, rejected, trips) after one call at `at` (microseconds)."""
    mode, failures, successes, opened, rejected, trips = state
    if mode == OPEN and at - opened >= OPEN_MICROS:
        mode, failures, successes = HALF, 0, 0
    if mode == OPEN:
        return mode, failures, successes, opened, rejected + 1, trips
    failures += failed
    successes += mode == HALF and not failed
    if failed and (mode == HALF or failures >= FAILURES):
        return OPEN, failures, 0, at, rejected, trips + 1
    if mode == HALF and successes >= SUCCESSES:
        return CLOSED, 0, 0, opened, rejected, trips
    return mode, failures, successes, opened, rejected, trips


class Breaker(Ordered):
    """The breaker of one key: its state is seven numbers, and the calls that the watermark hasn't passed.

    A timer isn't needed for the half-open moment to hold: it is a time of its
    own, at which the next call finds the breaker (see advance()); `half_open_at`
    tells it beforehand.
    """

    fields = ("failed",)
    event_schema = "at long, id long, failed boolean"
    state_schema = "calls long, mode int, failures int, successes int, opened long, rejected long, trips long"
    start = (0, *START)

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def take(self, state: tuple, event: tuple) -> tuple[tuple, None]:
        return (state[0] + 1, *advance(state[1:], event[0], bool(event[2]))), None

    def rows(self, key: tuple, state: tuple, results: list, settled: bool) -> Iterator[pd.DataFrame]:
        calls, mode, _, _, opened, rejected, trips = state
        half = opened + OPEN_MICROS if mode == OPEN else None
        yield pd.DataFrame({"key": [key[0]], "calls": [calls], "rejected": [rejected], "trips": [trips], "mode": pd.array([mode], "int32"), "half_open_at": pd.array([half], "Int64"), "settled": [settled]})


def stream(events: DataFrame, key: str, delay: str = "10 minutes", idle_seconds: int | None = None) -> DataFrame:
    """Update-mode stream of key, calls, rejected, trips, mode, half_open_at, settled from (key, ts, event_id, failed).

    Calls may come late by `delay`; later ones are dropped by the watermark.  A
    key without calls for `idle_seconds` is forgotten and begins anew; None: never.
    """
    calls = events.withWatermark("ts", delay).select(F.col(key).cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("id"), "failed")
    found = calls.groupBy("key").transformWithStateInPandas(statefulProcessor=Breaker(None if idle_seconds is None else 1000 * idle_seconds), outputStructType="key long, calls long, rejected long, trips long, mode int, half_open_at long, settled boolean", outputMode="Update", timeMode="EventTime")
    return found.withColumnRenamed("key", key)
