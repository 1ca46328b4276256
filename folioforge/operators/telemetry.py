"""Aggregates of match decisions and request times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import languages_conflict, region_language
from .scan import Ranges
from .scoring import band


def decision_metrics(d: DataFrame) -> DataFrame:
    """One row of counters over decisions (matched, manual, widened, pinned, corroborated, authorless, confidence, demoted)."""
    risky = F.col("matched") & ~F.col("pinned") & ~F.col("corroborated")
    auto = ~F.col("manual")
    return d.agg(
        F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), F.count_if("manual").alias("manual"), F.count_if("widened").alias("widened"),
        F.count_if("pinned").alias("pinned"), F.count_if("corroborated").alias("corroborated"), F.count_if(auto & risky).alias("risky"), F.count_if(auto & risky & F.col("authorless")).alias("risky_authorless"),
        F.count_if(auto & F.col("authorless")).alias("authorless"), F.count_if(F.col("demoted") > 0).alias("gated"), F.sum("demoted").alias("demoted"),
        (F.sum(F.when(F.col("matched"), F.coalesce("confidence", F.lit(0.0)))) / F.nullif(F.count_if("matched"), F.lit(0))).alias("avg_confidence"),
    )


def bands(d: DataFrame) -> DataFrame:
    return d.filter("matched").groupBy(band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


def latency(requests: DataFrame, path: str, order: list[str], value: str, last: int = 100) -> DataFrame:
    """Per path: count of all requests; sum, least, greatest and mean of the last ones.

    A path with very many requests is cut down by a rank within salted parts
    first, so that no task sorts all of them.
    """
    newest = [F.desc(c) for c in order]
    salt = F.pmod(F.xxhash64(*order), F.lit(64))
    part = requests.withColumn("_salt", salt)
    kept = part.withColumn("_r", F.row_number().over(Window.partitionBy(path, "_salt").orderBy(*newest))).filter(F.col("_r") <= last)
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(path).orderBy(*newest))).filter(F.col("_r") <= last)
    seen = requests.groupBy(path).agg(F.count("*").alias("n"))
    return seen.join(kept.groupBy(path).agg(F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")), path)


def language_mismatches(lookups: DataFrame) -> DataFrame:
    """lookups, mismatched: how many records (language, region) are in another language than their region's."""
    return lookups.agg(F.count("*").alias("lookups"), F.count_if(languages_conflict(F.col("language"), region_language(F.col("region")))).alias("mismatched"))


def megabytes(size: Column) -> Column:
    return F.round(size / 1024 / 1024, 2)


def milliseconds(nanos: Column) -> Column:
    return nanos / 1_000_000


def health(probes: DataFrame, key: str) -> DataFrame:
    """key, healthy by the last probe (key, part, at, up) of each part: a store that is up, and a cache that is up or absent."""
    last = lambda part: F.max_by("up", F.when(F.col("part") == part, F.col("at")))
    found = probes.groupBy(key).agg(last("store").alias("store"), last("cache").alias("cache"))
    return found.select(key, (F.coalesce("store", F.lit(False)) & F.coalesce("cache", F.lit(True))).alias("healthy"))


#: Seconds after which a probe counts as unanswered.
PROBE_SECONDS = 5.0


def health_changes(probes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """probes (key, part, up, took) with the key's health before each, null before its first, and after it.

    A key is healthy while its store is up, and its cache is up or has never
    been probed.  A probe that took too long, or has no result, found its part
    down; parts of other names change nothing.
    """
    up = F.coalesce(F.col("up") & (F.coalesce("took", F.lit(0.0)) <= PROBE_SECONDS), F.lit(False))
    of = lambda part: F.when(F.col("part") == part, up)
    known = Ranges(probes, key, order).last_values({"_store": of("store"), "_cache": of("cache"), "_seen": F.lit(True)}, own=False)
    healthy = lambda store, cache: F.coalesce(store, F.lit(False)) & F.coalesce(cache, F.lit(True))
    before = F.when(F.col("_seen"), healthy(F.col("_store"), F.col("_cache")))
    after = healthy(F.coalesce(of("store"), "_store"), F.coalesce(of("cache"), "_cache"))
    return known.withColumn("before", before).withColumn("after", after).drop("_store", "_cache", "_seen")


def uptime(changes: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """key, probes, healthy (after its last probe), outages, up_us and span_us: microseconds of health, and from its first to its last probe.

    Time in health is the sum of the moments at which it ends less those at
    which it begins, so it is a plain aggregate.
    """
    now = F.unix_micros(at)
    # Moments are large numbers; their sum may leave 64 bits on the way.
    step = F.coalesce(F.col("before"), F.lit(False)).cast("int") - F.col("after").cast("int")
    last = F.max_by("after", F.struct(*order))
    of = changes.groupBy(key).agg(
        F.count("*").alias("probes"), last.alias("healthy"), F.count_if(~F.col("after") & F.coalesce("before", F.lit(True))).alias("outages"),
        F.sum((now * step).cast("decimal(20,0)")).alias("_ended"), F.min(now).alias("_first"), F.max(now).alias("_last"),
    )
    up = F.col("_ended") + F.when(F.col("healthy"), F.col("_last")).otherwise(0)
    return of.select(key, "probes", "healthy", "outages", up.cast("long").alias("up_us"), (F.col("_last") - F.col("_first")).alias("span_us"))
