"""Answering requests for records: from the cache, else the store, else built; with the path of an update, and the cache afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stale

DAYS, TTL_SECONDS = 7, 5 * 86_400
#: Why a record can't be fetched any more though it was; what is stored then stays.
GONE = ("REGION_UNAVAILABLE", "PRODUCT_DELISTED")
NOT_FOUND = "NOT_FOUND"


def answered(requests: DataFrame, cache: DataFrame, stored: DataFrame, fetched: DataFrame, now: Column, days: float = DAYS, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """key, how, value, code, cached, cached_until for each requested key; a key that is asked for twice is answered once, as an update if either is one.

    requests: key, update.  cache: key, value (null: can't be read), expires_at.
    stored: key, value, updated_at.  fetched: what a fetch would give: key, value,
    code (null: it succeeds).  Keys of the last three are unique.

    how: cache; store; recent (an update of what was updated within `days`);
    updated; kept (an update of what is gone by now); created; failed, with a code.
    The cache holds what was served anew for `ttl_seconds`, else what it held.
    """
    asked = requests.groupBy("key").agg(F.max("update").alias("update"))
    held = cache.select("key", F.col("value").alias("_c"), F.col("expires_at").alias("_until")).filter(F.col("_until") > now)
    kept = stored.select("key", F.col("value").alias("_s"), F.col("updated_at").alias("_at"), F.lit(True).alias("_in"))
    new = fetched.select("key", F.col("value").alias("_f"), F.col("code").alias("_code"), F.lit(True).alias("_tried"))
    all_ = asked.join(held, "key", "left").join(kept, "key", "left").join(new, "key", "left")
    code = F.when(F.col("_tried").isNull(), NOT_FOUND).otherwise(F.col("_code"))
    in_store, update = F.coalesce(F.col("_in"), F.lit(False)), F.col("update")
    how = (
        F.when(F.col("_c").isNotNull() & ~update, "cache")
        .when(in_store & ~update, "store")
        .when(in_store & ~F.coalesce(stale(F.col("_at"), now, days), F.lit(True)), "recent")
        .when(code.isNull(), F.when(in_store, "updated").otherwise("created"))
        .when(in_store & code.isin(*GONE), "kept")
        .otherwise("failed")
    )
    told = all_.withColumn("how", how)
    is_ = lambda *names: F.col("how").isin(*names)
    value = F.when(is_("cache"), F.col("_c")).when(is_("store", "recent", "kept"), F.col("_s")).when(is_("updated", "created"), F.col("_f"))
    served = is_("store", "updated", "created")
    until = F.timestamp_micros(F.unix_micros(now) + ttl_seconds * 1_000_000)
    return told.select("key", "how", value.alias("value"), F.when(is_("failed"), code).alias("code"), F.when(served, value).otherwise(F.col("_c")).alias("cached"), F.when(served, until).otherwise(F.when(F.col("_c").isNotNull(), F.col("_until"))).alias("cached_until"))
