"""Authors and covers joined to records, each only where it is sure; reasons and delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import with_similarity, with_title_similarity
from ..functions.text import normalize_name, without_initials, initials
from ..sources.tables import cut_lineage

COVER_TITLE, COVER_AUTHOR = 0.8, 0.7


def author_profiles(old: DataFrame, preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """Author records (name, image, description): a preferred image replaces the old one, which is kept aside; the fallback fills gaps only."""
    named = lambda d, p: d.select(normalize_name(F.col("name")).alias("key"), F.col("image").alias(f"{p}_image"), F.col("description").alias(f"{p}_description")).dropDuplicates(["key"])
    joined = old.withColumn("key", normalize_name(F.col("name"))).join(named(preferred, "p"), "key", "left").join(named(fallback, "f"), "key", "left")
    swapped = F.col("p_image").isNotNull() & F.col("image").isNotNull() & (F.col("p_image") != F.col("image"))
    return joined.select("name", F.coalesce("p_image", "image", "f_image").alias("image"), F.when(swapped, F.col("image")).alias("image_alt"), F.coalesce("p_description", "description", "f_description").alias("description"))


def square_cover(hits: DataFrame) -> DataFrame:
    """record, cover: the best-titled hit (record, title, author, hit_title, hit_author, cover, pos) by an author near enough; the first of equals."""
    alike = ["record", "title", "author", "hit_title", "hit_author"]
    # Hits that are compared alike score alike, so their first stands for all; a table, as a filter would be pushed down to all hits.
    hits = cut_lineage(hits.groupBy(*alike).agg(F.min(F.struct("pos", "cover")).alias("_first")).select(*alike, "_first.pos", "_first.cover"))
    near = with_similarity(with_title_similarity(hits, "title", "hit_title", "t", least=COVER_TITLE), "author", "hit_author", "a")
    good = near.filter((F.col("t") >= COVER_TITLE) & (F.col("author").isNull() | (F.col("a") >= COVER_AUTHOR)))
    return good.groupBy("record").agg(F.min_by("cover", F.struct(-F.col("t"), "pos")).alias("cover"))


def one_per_name(authors: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The first author (name, pos, ..) of each name in any spelling of blanks and case, within groups."""
    return authors.withColumn("_k", normalize_name(F.col("name"))).withColumn("_r", F.row_number().over(Window.partitionBy(*within, "_k").orderBy("pos"))).filter("_r = 1").drop("_k", "_r")


def richness(image: Column, description: Column) -> Column:
    """How full an author record is: 2 for a portrait, 1 for a biography."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(has(image), 2).otherwise(0) + F.when(has(description), 1).otherwise(0)


def collapse_initials(authors: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Of authors (name, image, description, pos) alike but for middle initials the fullest, unless their initials differ; within groups."""
    sig = F.nullif(initials(F.col("name")), F.lit(""))
    full = richness(F.col("image"), F.col("description"))
    keyed = authors.withColumn("_k", without_initials(F.col("name"))).withColumn("_s", sig).withColumn("_f", full)
    apart = keyed.groupBy(*within, "_k").agg((F.countDistinct("_s") > 1).alias("_apart"))
    ranked = keyed.join(apart, [*within, "_k"]).withColumn("_r", F.row_number().over(Window.partitionBy(*within, "_k").orderBy(F.desc("_f"), "pos")))
    return ranked.filter("_apart OR _r = 1").drop("_k", "_s", "_f", "_apart", "_r")


def same_author(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with whether two names are one author's: alike as a whole, or in both first and last words."""
    word = lambda c, i: F.try_element_at(F.split(normalize_name(F.col(c)), " "), F.lit(i))
    parts = df.withColumns({"_a1": word(a, 1), "_b1": word(b, 1), "_a2": word(a, -1), "_b2": word(b, -1)})
    parts = with_similarity(with_similarity(with_similarity(parts, a, b, "_w"), "_a1", "_b1", "_f"), "_a2", "_b2", "_l")
    return parts.withColumn(out, (F.col("_w") >= 0.9) | ((F.col("_f") >= 0.85) & (F.col("_l") >= 0.85))).drop("_a1", "_b1", "_a2", "_b2", "_w", "_f", "_l")


def availability(state: Column, delisted: Column) -> Column:
    """Why a product has no record here."""
    return F.when(delisted, "PRODUCT_DELISTED").when(state.isNull(), "NOT_FOUND").when(state != "AVAILABLE", "REGION_UNAVAILABLE")


#: What a product's delivery type must be to be a book, and what a podcast's is.
BOOK_TYPES, PODCAST_TYPE = ("MultiPartBook", "SinglePartBook"), "PodcastParent"


def content_mismatch(kind: Column) -> Column:
    """What a product is instead of a book; null for a book, and for a type that isn't known, which the record's schema then judges."""
    return F.when(kind == PODCAST_TYPE, F.lit("podcast"))


def chapter_mismatch(kind: Column) -> Column:
    """What a product without chapters is: any type but a book's, `unknown` where it has none."""
    return F.when(~F.coalesce(kind.isin(*BOOK_TYPES), F.lit(False)), F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")))


def document_kind(json: Column) -> Column:
    """author, book or chapter by the keys that a stored document has; null without an id."""
    keys = F.json_object_keys(json)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return F.when(has("_id"), F.when(has("name"), "author").when(has("title"), "book").when(has("runtimeLengthMs"), "chapter"))


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Milliseconds to wait, null to give up: what the server asks for up to ten seconds, else doubling from one to eight."""
    wait = F.when(retry_after.isNotNull(), retry_after * 1000).otherwise(F.least(F.pow(F.lit(2.0), attempt) * 1000, F.lit(8000.0)))
    return F.when(wait <= 10_000, wait.cast("long"))
