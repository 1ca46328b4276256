"""Requests of a log against a loop that tries them one by one."""

import random
from datetime import datetime, timedelta, timezone
from email.utils import format_datetime

import pytest
from pyspark.sql import functions as F

from folioforge.operators import retries

START = datetime(2024, 2, 28, 23, 59, 50, tzinfo=timezone.utc)
HEADERS = [None, "", "soon", "0", "-4", "3", " 7", "+2", "007", "10", "11", "3600", "9" * 40, "4.9", "5 apples", "Wed, 32 Foo 2024 00:00:00 GMT"]


def asked(header, at):
    """Milliseconds that a header asks for, by its text."""
    text = (header or "").strip()
    digits = text.lstrip("+")
    digits = digits[: len(digits) - len(digits.lstrip("0123456789"))]
    if digits and int(digits) > 0:
        return int(digits) * 1000
    try:
        when = datetime.strptime(text, "%a, %d %b %Y %H:%M:%S GMT").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    left = (when - at) // timedelta(milliseconds=1)
    return left if left > 0 else None


def tried(responses):
    """(attempts, outcome, waited) of each request that takes its responses off the list."""
    out, left = [], list(responses)
    while left:
        n = waited = 0
        outcome = "open"
        while left and outcome == "open":
            at, status, header = left.pop(0)
            n += 1
            if status == 200:
                outcome = "done"
            elif n == 4:
                outcome = "failed"
            elif status == 429:
                wait = asked(header, at) or min(1000 * 2 ** (n - 1), 8000)
                outcome, waited = ("gave up", waited) if wait > 10_000 else ("open", waited + wait)
        out.append((n, outcome, waited))
    return out


def log_of(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(milliseconds=rng.randrange(40_000))
        dated = format_datetime(at.replace(microsecond=0) + timedelta(seconds=rng.randrange(-5, 20)), usegmt=True)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), i, at, rng.choice([200, 429, 429, 429, 500, None]), rng.choice([*HEADERS, dated, dated, dated])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_requests_of_hot_keys(spark, seed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = log_of(seed)
        log = spark.createDataFrame(rows, "k long, id long, at timestamp, status int, retry_after string").repartition(5)
        got = {}
        for r in retries.requests(retries.attempts(log, "k", ["at", "id"]), "k").orderBy("k", "request").collect():
            got.setdefault(r.k, []).append((r.attempts, r.outcome, r.waited_ms))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {k: tried([(r[2], r[3], r[4]) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))]) for k in {r[0] for r in rows}}
    assert got == want
    assert {o for x in want.values() for _, o, _ in x} >= {"done", "failed", "gave up"}


def test_headers(spark):
    now = F.lit(START).cast("timestamp")
    dates = [format_datetime(START + timedelta(seconds=s), usegmt=True) for s in (-1, 0, 1, 10, 11)]
    df = spark.createDataFrame([(h,) for h in [*HEADERS, *dates]], "h string").select("h", retries.asked_ms(F.col("h"), now).alias("ms"))
    for r in df.collect():
        want = asked(r.h, START)
        assert r.ms == want or (r.ms > 10_000 and want > 10_000), r.h


def test_no_log(spark):
    log = spark.createDataFrame([], "k long, id long, at timestamp, status int, retry_after string")
    assert retries.requests(retries.attempts(log, "k", ["at", "id"]), "k").collect() == []
