"""Keyed tables: lookups, conditional upserts, deletes, time-to-live caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, asin: str, region: str) -> DataFrame:
    """Records of a key in a region, or of no region."""
    return df.filter((F.col("asin") == asin) & (F.col("region").isNull() | (F.col("region") == region)))


def upsert_actions(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], gate: Callable[[str], Column], touch: bool = False) -> DataFrame:
    """keys, action and the values that hold afterwards.

    insert: the key is new.  update: it differs and the gate is open.  keep: it
    differs and the gate is shut.  touch or noop: it is equal.  stay: it is in
    no new row.
    """
    a = old.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full_outer")
    equal = F.col("_old").eqNullSafe(F.col("_new"))
    action = (
        F.when(F.col("_in_old").isNull(), "insert")
        .when(F.col("_in_new").isNull(), "stay")
        .when(equal, "touch" if touch else "noop")
        .when(gate("_new."), "update")
        .otherwise("keep")
    )
    picked = F.when(action.isin("insert", "update"), F.col("_new")).otherwise(F.col("_old"))
    return both.select(*keys, action.alias("action"), picked.alias("_v")).select(*keys, "action", "_v.*")


def upsert_records(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], gate: Callable[[str], Column], now: Column, touch: bool = False) -> DataFrame:
    """upsert_actions() on records with created_at and updated_at: updates keep the first time, change the second; a touch changes the second only."""
    done = upsert_actions(old, new, keys, values, gate, touch)
    times = old.select(*keys, F.col("created_at").alias("_c"), F.col("updated_at").alias("_u"))
    both = done.join(times, keys, "left")
    return both.select(*keys, "action", *values, F.coalesce("_c", now).alias("created_at"), F.when(F.col("action").isin("insert", "update", "touch"), now).otherwise(F.col("_u")).alias("updated_at"))


#: When a fetched record may replace a stored one.
GATES: dict[str, Callable[[str], Column]] = {
    "book": lambda p: F.coalesce(F.size(F.col(f"{p}genres")) > 0, F.lit(False)),
    "author": lambda p: F.coalesce(F.col(f"{p}name") != "", F.lit(False)),
    "chapter": lambda p: F.coalesce(F.size(F.col(f"{p}chapters")) > 0, F.lit(False)),
}


def projected(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a schema from stored JSON (json); rows that lack a field declared NOT NULL are left out."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    parsed = df.select(F.from_json("json", schema.replace(" NOT NULL", "")).alias("r")).select("r.*")
    needed = [f.name for f in kind.fields if not f.nullable]
    return parsed.dropna(subset=needed) if needed else parsed


def with_misses(cached: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """keys with their cached value and how it stands: hit, miss (known to have none: the text null), absent."""
    found = keys.join(cached.select(key, F.col(value).alias("_v"), F.lit(True).alias("_in")), key, "left")
    how = F.when(F.col("_in").isNull(), "absent").when(F.col("_v") == "null", "miss").otherwise("hit")
    return found.select(key, F.when(how == "hit", F.col("_v")).alias(value), how.alias("how"))


def cached_values(rows: DataFrame, schema: str, now: Column, days: float, dates: list[str] = ()) -> DataFrame:
    """key and the columns of its newest value (rows: key, ts, seq, body) that is younger than `days`; values that can't be read are none.

    dates: fields that are dates kept as text; they become times, null where empty or no date.
    """
    last = rows.groupBy("key").agg(F.max_by("body", F.struct("ts", "seq")).alias("body"), F.max("ts").alias("ts")).filter(~stale(F.col("ts"), now, days))
    read = last.select("key", F.from_json("body", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("v")).filter("v IS NOT NULL AND v._bad IS NULL").select("key", "v.*").drop("_bad")
    return read.withColumns({d: F.try_to_timestamp(F.nullif(F.col(d), F.lit(""))) for d in dates})


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def cache_split(probes: DataFrame, writes: DataFrame, ttl_seconds: int) -> DataFrame:
    """probes (key, ts) with `hit`: a write of the key no older than the ttl comes at or before it.

    The last write before each probe comes from a scan in ranges, so a hot key is
    dealt over many tasks; there is no join on time.
    """
    from .scan import Ranges

    # Writes of one moment are one; probes of one moment find the same, so they are scanned once.
    asked = probes.select("key", "ts", F.lit(1).alias("kind")).distinct()
    both = asked.unionByName(writes.select("key", "ts", F.lit(0).alias("kind")).distinct())
    last = Ranges(both, "key", ["ts", "kind"]).last_known(F.when(F.col("kind") == 0, F.col("ts")), "written").filter("kind = 1")
    age = F.unix_micros("ts") - F.unix_micros("written")
    hit = last.select(F.col("key").alias("_key"), F.col("ts").alias("_ts"), F.coalesce(age <= ttl_seconds * 1_000_000, F.lit(False)).alias("hit"))
    return probes.select("key", "ts").join(hit, F.col("key").eqNullSafe(F.col("_key")) & F.col("ts").eqNullSafe(F.col("_ts"))).select("key", "ts", "hit")


def stale(updated: Column, now: Column, days: float = 7) -> Column:
    """Not updated within the last days."""
    return (F.unix_micros(now) - F.unix_micros(updated)) / 86_400e6 >= days


def first_of(df: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """df with `value` from the first source, in order, that has the key, and that source's place."""
    from functools import reduce

    found = reduce(DataFrame.unionByName, [s.select(key, F.col(value).alias(value), F.lit(i).alias("source")) for i, s in enumerate(sources)])
    best = found.groupBy(key).agg(F.min_by(value, "source").alias(value), F.min("source").alias("source"))
    return df.join(best, key, "left")
