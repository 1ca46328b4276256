"""Stateful streams over many batches, with events out of order, against folds over everything in order."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioforge.streaming import breaker, cache, rings
from folioforge.streaming.run import drained

MINUTE = 60_000_000


def events(seed, n=600, keys=4):
    rng = random.Random(seed)
    at, out = 1_700_000_000_000_000, []
    for i in range(n):
        at += rng.choice([1, 500, 1_000_000, 20_000_000, 45_000_000])
        out.append((min(rng.randrange(keys * 2), keys - 1), i, at, rng.random() < 0.45, rng.choice([cache.PROBE, cache.PROBE, cache.WRITE, cache.KNOWN_MISS]), rng.random()))
    return out


def stream(spark, folder, rows, files, late=0):
    """The rows as files, one to a batch; a row may come up to `late` microseconds after its time."""
    rng = random.Random(9)
    arriving = sorted(rows, key=lambda r: r[2] + rng.randrange(late + 1))
    os.makedirs(folder)
    size = -(-len(rows) // files)
    for f in range(files):
        part = arriving[f * size : (f + 1) * size]
        columns = list(zip(*part, strict=True))
        t = pa.table({"key": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "ts": pa.array(columns[2], pa.timestamp("us", "UTC")), "failed": columns[3], "kind": pa.array(columns[4], pa.int32()), "value": columns[5]})
        pq.write_table(t, f"{folder}/{f}.parquet")
        os.utime(f"{folder}/{f}.parquet", (1_600_000_000 + f, 1_600_000_000 + f))
    df = spark.readStream.schema("key long, id long, ts timestamp, failed boolean, kind int, value double").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    return df


@pytest.mark.parametrize("files,late", [(1, 0), (7, 4 * MINUTE), (12, 0)])
def test_breaker(spark, tmp_path, files, late):
    rows = events(1)
    calls = stream(spark, f"{tmp_path}/e", rows, files, late).withColumnRenamed("id", "event_id")
    out = drained(breaker.stream(calls, "key"), "update").collect()
    want = {}
    for key, _, at, failed, *_ in sorted(rows, key=lambda r: r[1:3][::-1]):
        calls_, *state = want.get(key, (0, *breaker.START))
        want[key] = (calls_ + 1, *breaker.advance(tuple(state), at, failed))
    last = {}
    for r in sorted(out, key=lambda r: (r.batch, r.calls)):
        last[r.key] = (r.calls, r.rejected, r.trips, r.mode)
    assert last == {k: (v[0], v[5], v[6], v[1]) for k, v in want.items()} and sum(v[6] for v in want.values()) > 10
    assert all((r.half_open_at is None) == (r["mode"] != breaker.OPEN) for r in out)
    if files > 1:
        assert any(r.settled for r in out)


def test_an_idle_key_is_forgotten(spark, tmp_path):
    """Days apart: key 1 begins anew after a day without calls, key 2 calls all along."""
    day = 24 * 60 * MINUTE
    rows = [(k, 10 * d + k, 1_700_000_000_000_000 + d * day // 2, True, 1, 0.0) for d in range(12) for k in (1, 2) if k == 2 or d in (0, 1, 8, 9)]
    for idle, want in ((86_400, {1: 2, 2: 12}), (None, {1: 4, 2: 12})):
        calls = stream(spark, f"{tmp_path}/{idle}", rows, 8).withColumnRenamed("id", "event_id")
        out = drained(breaker.stream(calls, "key", idle_seconds=idle), "update").collect()
        assert {r.key: r.calls for r in sorted(out, key=lambda r: (r.batch, r.calls))} == want


def asked(rows, ttl, builds):
    entry, out = {}, {}
    for key, i, at, _, kind, _ in sorted(rows, key=lambda r: (r[2], r[4] == cache.PROBE)):
        written, empty = entry.get(key, (None, False))
        if kind != cache.PROBE:
            entry[key] = (at, kind == cache.KNOWN_MISS)
        elif written is not None and at - written <= ttl:
            out[i] = cache.MISS if empty else cache.HIT
        else:
            out[i] = cache.BUILT if builds else cache.ABSENT
            if builds:
                entry[key] = (at, False)
    return out


@pytest.mark.parametrize("files,late,builds", [(1, 0, False), (6, 4 * MINUTE, False), (6, 4 * MINUTE, True)])
def test_cache(spark, tmp_path, files, late, builds):
    rows = events(2)
    out = drained(cache.read_through(stream(spark, f"{tmp_path}/e", rows, files, late), 60, builds), "update")
    found = {r.id: r.how for r in cache.last_found(out).collect()}
    assert found == asked(rows, MINUTE, builds) and len(set(found.values())) == 3
    settled = out.filter("settled")
    assert settled.count() == settled.select("id").distinct().count()


@pytest.mark.parametrize("files", [1, 8])
def test_rings(spark, tmp_path, files):
    rows = events(3)
    random.Random(4).shuffle(rows)
    out = drained(rings.rings(stream(spark, f"{tmp_path}/e", rows, files, 100 * MINUTE), 20), "update")
    got = {}
    for r in rings.merged(out, 20).collect():
        got.setdefault((int(r.key), r.seen), set()).add((r.at, r.id))
    want = {}
    for key, i, at, *_ in rows:
        want.setdefault(key, []).append((at, i))
    assert got == {(k, len(v)): set(sorted(v)[-20:]) for k, v in want.items()}
    # No ring ever holds more than its size.
    assert out.groupBy("key", "shard", "batch").count().agg(F.max("count")).first()[0] <= 20
