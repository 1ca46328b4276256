"""Fuzzy search of a table of requests against candidate sources.

requests: query_id, title, author, track, asin, narrator, duration_ms, region.
A source gives candidates (source columns of CANDIDATE plus query_id); sources
are united in order, which is part of the ranking.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..functions.similarity import with_similarity, with_title_similarity
from ..sources.tables import cut_lineage
from . import scoring
from .dedupe import CANDIDATE, dedupe_and_rank

AUTO_APPLY = 0.9


def prepared(requests: DataFrame) -> DataFrame:
    """requests with the wanted id, both normalised titles, author names and language."""
    c = F.col
    main = T.normalize_title(T.without_edge_brackets(c("title")))
    track = T.normalize_title(T.without_edge_brackets(c("track")))
    own = F.nullif(F.upper(F.trim(c("asin"))), F.lit(""))
    return requests.select(
        "query_id", "region", "narrator", F.coalesce(own, T.bracketed_asin(c("title"))).alias("want_asin"), main.alias("main"),
        F.when((track != "") & (F.lower(track) != F.lower(main)), track).alias("alt"), T.split_authors(c("author")).alias("want_authors"),
        (F.when(c("duration_ms") > 0, c("duration_ms")) / 1000.0).alias("want_seconds"), L.region_language(c("region")).alias("want_language"),
        F.array_union(T.volume_numbers(c("title")), T.volume_numbers(c("track"))).alias("want_volumes"),
        (T.is_bundle(c("title")) | T.is_bundle(c("track"))).alias("want_bundle"), (T.is_foreign_edition(c("title")) | T.is_foreign_edition(c("track"))).alias("want_foreign"),
    ).filter((F.col("main") != "") | F.col("alt").isNotNull())


def scored(pairs: DataFrame, wanted: str) -> DataFrame:
    """pairs (prepared requests with candidates) with confidence and delta for the title column `wanted`.

    Titles and author lists are made distinct before their spellings and names
    are opened into rows; each pair of strings is compared once, and the best
    of each title pair and each pair of lists is taken back.
    """
    titles = pairs.select(F.col(wanted).alias("_w"), F.col("title").alias("_t")).distinct()
    spelt = titles.select("_w").distinct().select("_w", F.explode(T.title_variants(F.col("_w"))).alias("w"))
    # 0.3 can't bring a title to the floor, whatever author and running time add.
    best_title = with_title_similarity(titles.join(spelt, "_w"), "w", "_t", "t", least=0.3).groupBy("_w", "_t").agg(F.max("t").alias("t"))
    lists = pairs.select(F.col("want_authors").alias("_wa"), F.col("authors").alias("_ha")).distinct()
    names = lists.select("_wa", "_ha", F.explode("_wa").alias("wa")).select("_wa", "_ha", "wa", F.explode("_ha").alias("ha"))
    best_author = with_similarity(names, "wa", "ha", "a").groupBy("_wa", "_ha").agg(F.max("a").alias("a"))
    authorless = F.element_at("want_authors", 1) == ""
    out = pairs.join(best_title, (F.col(wanted) == F.col("_w")) & (F.col("title") == F.col("_t")), "left").join(best_author, (F.col("want_authors") == F.col("_wa")) & (F.col("authors") == F.col("_ha")), "left").drop("_w", "_t", "_wa", "_ha")
    out = out.withColumn("t", F.coalesce("t", F.lit(0.0))).withColumn("authorless", authorless)
    out = out.withColumn("delta", scoring.duration_delta(F.col("want_seconds"), F.col("audio_seconds")))
    return out.withColumn("confidence", scoring.confidence(F.col("t"), F.when(~F.col("authorless"), F.coalesce("a", F.lit(0.0))), F.col("delta")))


def _judged(pairs: DataFrame) -> DataFrame:
    """Confidence with all penalties, at or above the floor, as CANDIDATE."""
    c = F.col
    key = ["query_id", "provider", "id"]
    pairs = cut_lineage(pairs)
    main = scored(pairs, "main")
    alt = scored(pairs.filter("alt IS NOT NULL"), "alt").select(*key, c("confidence").alias("alt_confidence"), c("delta").alias("alt_delta"))
    both = main.join(alt, key, "left")
    better = F.coalesce(c("alt_confidence") > c("confidence"), F.lit(False))
    both = both.withColumn("delta", F.when(better, c("alt_delta")).otherwise(c("delta"))).withColumn("confidence", F.when(better, c("alt_confidence")).otherwise(c("confidence")))
    both = both.withColumn("pinned", F.coalesce(F.upper("asin") == c("want_asin"), F.lit(False))).withColumn("language", L.normalize_language(c("language")))
    both = both.withColumn("language_conflict", F.coalesce(c("language") != c("want_language"), F.lit(False))).withColumn("bundle", T.is_bundle(c("title")) & ~c("want_bundle")).withColumn("junk", T.is_ai_narrated(c("narrators")))
    conf = scoring.penalised(
        c("confidence"), pinned=c("pinned"), authorless=c("authorless"), delta=c("delta"), language_conflict=c("language_conflict"), foreign=~c("want_foreign") & T.is_foreign_edition(c("title")),
        bundle=c("bundle"), ai=c("junk"), volume=T.volumes_conflict(c("want_volumes"), T.volume_numbers(c("title"))),
    )
    want = T.alnum_key(c("narrator"))
    heard = F.exists("narrators", lambda n: T.alnum_key(n).contains(want) | (want.contains(T.alnum_key(n)) & (T.alnum_key(n) != "")))
    both = both.withColumn("confidence", conf).withColumn("narrator_match", F.coalesce((F.length(want) >= 4) & heard, F.lit(False)))
    return both.filter(c("confidence") >= scoring.FLOOR).select(*(x.split()[0] for x in CANDIDATE.split(", ")))


def united(sources: list[DataFrame]) -> DataFrame:
    """All sources' candidates with each source's place."""
    return reduce(DataFrame.unionByName, [s.withColumn("provider_pos", F.lit(i)) for i, s in enumerate(sources)])


def search(requests: DataFrame, sources: list[DataFrame], wider: list[DataFrame] | None = None) -> DataFrame:
    """Ranked editions of each request.

    wider: candidates found by the track title; they join in for requests that
    have one and whose best match is weak, or whose title holds the track title.
    """
    # A table: titles are normalised by many patterns, and three joins ask for them.
    wanted = cut_lineage(prepared(requests))
    key = ["query_id", "provider", "id"]
    found = united(sources)
    judged = cut_lineage(_judged(wanted.join(found, "query_id")))
    first = cut_lineage(dedupe_and_rank(judged))
    if wider is None:
        return first
    top = first.groupBy("query_id").agg(F.max("confidence").alias("top"))
    weak = wanted.filter("alt IS NOT NULL").join(top, "query_id", "left").filter((F.coalesce("top", F.lit(0.0)) < AUTO_APPLY) | F.lower("main").contains(F.lower("alt"))).select("query_id")
    weak = cut_lineage(weak)
    # What the first pass has judged stays judged; only candidates that it hasn't seen are compared.
    more = united(wider).withColumn("provider_pos", F.col("provider_pos") + len(sources)).join(weak, "query_id", "left_semi").join(found.select(*key), key, "left_anti").dropDuplicates(key)
    fresh = _judged(wanted.join(more, "query_id"))
    pool = judged.join(weak, "query_id", "left_semi").dropDuplicates(key).unionByName(fresh)
    return first.join(weak, "query_id", "left_anti").unionByName(dedupe_and_rank(pool))
