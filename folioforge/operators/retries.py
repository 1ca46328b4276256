"""Requests read off a log of responses: which attempts belong together, what each of them waits, how they end.

A log has, for each response, a key, the moment `at`, its `status` and its
`retry_after` header, in an order that tells a key's responses apart.  A request
is tried until it succeeds, at most TRIES times.  Too many requests make it
wait: as long as the server asks, else doubling from one second to eight; where
the server asks for more than LONGEST_MS it gives up at once.  Other failures
are tried again without a wait.

A success, and a server that asks for too long, end a run of responses whatever
came before; within a run each TRIES responses are a request.  So requests are
found by a range scan, and no key has to fit into a task.

Defined results: a null status is a failure; a header that can't be read, asks
for nothing or for a moment gone by counts as none; a log's last request may be
`open`; responses of the null key are one key's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Ranges

OK, TOO_MANY = 200, 429
TRIES, LONGEST_MS, FIRST_MS, MOST_MS = 4, 10_000, 1_000, 8_000

#: A date as HTTP writes it, without its weekday and zone.
_DATE = r"^[A-Za-z]{3,9}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$"


def asked_ms(header: Column, now: Column) -> Column:
    """Milliseconds from `now` that a Retry-After header asks for, by seconds or by a date; null where it asks for none."""
    digits = F.regexp_extract(header, r"^\s*\+?0*(\d*)", 1)
    # Numbers of six digits and more all ask for too long.
    seconds = F.when(F.length(digits) > 5, F.lit(100_000)).when(digits != "", digits.try_cast("long"))
    until = F.try_to_timestamp(F.concat(F.regexp_extract(F.trim(header), _DATE, 1), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    left = F.unix_millis(until) - F.unix_millis(now)
    return F.coalesce(seconds * 1000, F.when(left > 0, left))


def doubling_ms(attempt: Column) -> Column:
    """Milliseconds after an attempt, counted from 0, that nothing is asked for."""
    return F.least(F.pow(F.lit(2.0), attempt) * FIRST_MS, F.lit(float(MOST_MS))).cast("long")


def attempts(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """log with request (the place of its first response within the key), attempt (from 0), wait_ms, and outcome: done, failed, gave up, or open where it is tried again."""
    asked = F.when(F.col("status") == TOO_MANY, asked_ms(F.col("retry_after"), F.col("at")))
    over = F.coalesce(F.col("_asked") > LONGEST_MS, F.lit(False))
    done = F.coalesce(F.col("status") == OK, F.lit(False))
    rows = Ranges(log.withColumn("_asked", asked), key, order).runs(done | over, "_run", "_place")
    rows = rows.withColumn("attempt", F.pmod(F.col("_place") - 1, F.lit(TRIES))).withColumn("request", F.col("_run") + F.col("_place") - 1 - F.col("attempt"))
    outcome = F.when(done, "done").when(F.col("attempt") == TRIES - 1, "failed").when(over, "gave up").otherwise("open")
    waits = (F.col("outcome") == "open") & (F.col("status") == TOO_MANY)
    rows = rows.withColumn("outcome", outcome).withColumn("wait_ms", F.when(waits, F.coalesce("_asked", doubling_ms(F.col("attempt")))))
    return rows.drop("_asked", "_run", "_place")


def requests(tried: DataFrame, key: str) -> DataFrame:
    """key, request, attempts, outcome, waited_ms: one row for each request of `attempts`."""
    last = F.max_by("outcome", "attempt")
    return tried.groupBy(key, "request").agg(F.count("*").alias("attempts"), last.alias("outcome"), F.coalesce(F.sum("wait_ms"), F.lit(0)).alias("waited_ms"))
