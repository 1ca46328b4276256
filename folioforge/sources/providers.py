"""Sources of candidates: snapshots of provider answers as DataFrames in one shape.

A source is anything with a `name` and `candidates(answers) -> DataFrame`;
answers carry query_id, region, item_pos and one provider document each.  They
are kept in the order of registration, which the ranking uses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..operators.records import by_role, duration_seconds, largest, text_or_field

SHAPE = ("query_id", "provider", "item_pos", "id", "asin", "title", "authors", "narrators", "audio_seconds", "cover", "language")


class Source(Protocol):
    name: str

    def candidates(self, answers: DataFrame) -> DataFrame: ...


def _names(people: Column) -> Column:
    return F.coalesce(F.filter(F.transform(people, lambda p: p["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), F.array().cast("array<string>"))


def _shape(df: DataFrame, name: str, **values: Column) -> DataFrame:
    none = {"asin": F.lit(None).cast("string"), "narrators": F.array().cast("array<string>"), "audio_seconds": F.lit(None).cast("double"), "cover": F.lit(None).cast("string"), "language": F.lit(None).cast("string")}
    have = none | values
    return df.select("query_id", F.lit(name).alias("provider"), "item_pos", *(have[c].alias(c) for c in SHAPE[3:]))


def preferred_language(df: DataFrame, language: Column, group: list[str]) -> DataFrame:
    """Rows in the region's language or in none known; all of a group that has neither.

    Groups that have some are found by an aggregate, so a group of very many rows needs no window.
    """
    want = L.region_language(F.col("region"))
    marked = df.withColumn("_keep", want.isNull() | language.isNull() | (language == want))
    some = marked.filter("_keep").select(*group).distinct().withColumn("_some", F.lit(True))
    return marked.join(some, group, "left").filter("_keep OR _some IS NULL").drop("_keep", "_some")


def audible(df: DataFrame) -> DataFrame:
    """Store hits: asin, title, authors, narrators, runtime_length_min, product_images, language."""
    return _shape(df.filter("asin IS NOT NULL"), "audible", id=F.col("asin"), asin=F.col("asin"), title=F.coalesce("title", F.lit("")), authors=_names(F.col("authors")), narrators=_names(F.col("narrators")), audio_seconds=(F.col("runtime_length_min") * 60).cast("double"), cover=largest(F.col("product_images")), language=L.normalize_language(F.col("language")))


def hardcover(df: DataFrame) -> DataFrame:
    """Books with nested audio editions: one row per edition in a fitting language, the book itself where it has none."""
    people = lambda c, narrators: _names(F.transform(by_role(c, "contribution", narrators), lambda x: x["author"]))
    want = L.region_language(F.col("region"))
    spoken = lambda e: L.normalize_language(e["language"]["language"])
    fitting = F.filter("editions", lambda e: want.isNull() | spoken(e).isNull() | (spoken(e) == want))
    rows = df.withColumn("eds", F.when(F.size(fitting) > 0, fitting).otherwise(F.col("editions"))).select("*", F.posexplode_outer("eds").alias("ed_pos", "ed"))
    ed = F.col("ed")
    own = people(ed["contributions"], False)
    rows = rows.withColumn("item_pos", F.col("item_pos") * 100 + F.coalesce("ed_pos", F.lit(0)))
    return _shape(
        rows, "hardcover", id=F.when(ed["id"].isNotNull(), F.concat(F.lit("hardcover-edition-"), ed["id"].cast("string"))).otherwise(F.concat(F.lit("hardcover-book-"), F.col("id").cast("string"))), asin=ed["asin"], title=F.coalesce("title", F.lit("")),
        authors=F.when(F.size(own) > 0, own).otherwise(people(F.col("contributions"), False)), narrators=people(ed["contributions"], True), audio_seconds=ed["audio_seconds"].cast("double"), cover=F.coalesce(ed["cached_image"]["url"], F.col("cached_image.url")), language=spoken(ed),
    )


def apple(df: DataFrame) -> DataFrame:
    """Store hits: collectionId, collectionName, artistName, artworkUrl100."""
    good = df.filter("collectionId IS NOT NULL AND coalesce(collectionName, '') != ''")
    return _shape(good, "apple", id=F.concat(F.lit("apple-audiobook-"), F.col("collectionId").cast("string")), title=T.clean_store_title(F.col("collectionName")), authors=F.when(F.coalesce("artistName", F.lit("")) != "", F.array("artistName")).otherwise(F.array().cast("array<string>")), cover=T.square_cover(F.col("artworkUrl100")))


def storytel(df: DataFrame, base: str = "https://www.storytel.com") -> DataFrame:
    """Hits with book and abook; ebooks alone are left out; the first eight of each query."""
    language = L.normalize_language(F.col("book.language.isoValue"))
    good = preferred_language(df, language, ["query_id"]).filter("abook IS NOT NULL AND book.consumableId IS NOT NULL AND coalesce(book.name, '') != ''")
    first = good.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("item_pos"))).filter("_r <= 8")
    path = F.col("book.largeCover")
    return _shape(first, "storytel", id=F.concat(F.lit("storytel-"), F.col("book.consumableId").cast("string")), title=F.col("book.name"), authors=_names(F.col("book.authors")), narrators=_names(F.col("abook.narrators")), audio_seconds=F.when(F.col("abook.length") > 0, F.round(F.col("abook.length") / 1000)).cast("double"), cover=F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), path)), language=language)


#: The format a library's search asks for, and how many it gives.
AUDIO_FORMAT, PER_PAGE = "audiobook-overdrive", 5


def library_page(media: DataFrame, library: str, most: int = PER_PAGE) -> DataFrame:
    """What a library's search gives of its media (library, query_id, item_pos, formats): audiobooks, the first of each query."""
    own = media.filter((F.col("library") == library) & F.exists("formats", lambda f: f["id"] == AUDIO_FORMAT))
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("item_pos"))).filter(F.col("_r") <= most).drop("_r")


def overdrive(df: DataFrame) -> DataFrame:
    """Library media: title (text or object), creators, formats, covers, languages."""
    title = text_or_field(F.col("title"), "main")
    role = lambda r: _names(F.filter("creators", lambda c: F.lower(F.coalesce(c["role"], F.lit(""))) == r))
    seconds = F.get(F.filter(F.transform("formats", lambda f: duration_seconds(f["duration"])), lambda s: s.isNotNull()), F.lit(0))
    covers = F.filter(F.map_values("covers"), lambda c: c["href"].isNotNull())
    widest = F.array_max(F.transform(covers, lambda c: F.coalesce(c["width"], F.lit(0))))
    cover = F.get(F.filter(covers, lambda c: F.coalesce(c["width"], F.lit(0)) == widest), F.lit(0))["href"]
    tongue = F.get("languages", F.lit(0))
    good = df.filter(F.col("id").isNotNull() & (F.coalesce(title, F.lit("")) != ""))
    return _shape(good, "overdrive", id=F.concat(F.lit("overdrive-"), F.col("id").cast("string")), title=title, authors=role("author"), narrators=role("narrator"), audio_seconds=seconds.cast("double"), cover=cover, language=L.normalize_language(F.coalesce(tongue["id"], tongue["name"])))


def openlibrary(df: DataFrame) -> DataFrame:
    """Catalogue documents: key, title, author_name, cover_i, language."""
    key = F.regexp_replace(F.coalesce("key", F.lit("unknown")), r"^/?works/", "")
    cover = F.when(F.col("cover_i").isNotNull(), F.concat(F.lit("https://covers.openlibrary.org/b/id/"), F.col("cover_i").cast("string"), F.lit("-L.jpg")))
    return _shape(df, "openlibrary", id=F.concat(F.lit("openlibrary-works-"), key), title=T.title_case(F.coalesce("title", F.lit(""))), authors=F.coalesce("author_name", F.array().cast("array<string>")), cover=cover, language=L.normalize_language(F.get("language", F.lit(0))))


def dispatch(ids: DataFrame, id: str, books: dict[str, DataFrame]) -> DataFrame:
    """ids with the record behind each, found by the provider, kind and own id that it stands for.

    books: for each provider that has records native, kind (null: any) and the
    same further columns.  state: no id (a store's own id, or none), no source (a
    provider without records), not found, found.
    """
    asked = ids.select(F.col(id).alias("_id")).filter("_id IS NOT NULL").distinct()
    # Opened as a row of its own, so that its patterns stand in the plan once.
    asked = asked.select("_id", F.explode(F.filter(F.array(T.decode_id(F.col("_id"))), lambda d: d.isNotNull())).alias("d"))
    known = reduce(DataFrame.unionByName, [b.withColumn("provider", F.lit(name)) for name, b in books.items()])
    values = [c for c in known.columns if c not in ("native", "kind", "provider")]
    first = known.groupBy("provider", "native", "kind").agg(F.min(F.struct(*values)).alias("_book")).withColumnRenamed("kind", "_kind")
    wanted = asked.select("_id", "d.provider", "d.kind", "d.native")
    found = wanted.join(first, ["provider", "native"]).filter(F.col("_kind").isNull() | F.col("_kind").eqNullSafe(F.col("kind")))
    found = found.groupBy("_id").agg(F.min_by("_book", F.col("_kind").isNull()).alias("_book"))
    told = ids.join(wanted.select("_id", F.col("provider").alias("_provider")), F.col(id) == F.col("_id"), "left").drop("_id").join(found, F.col(id) == F.col("_id"), "left").drop("_id")
    state = F.when(F.col("_provider").isNull(), "no id").when(~F.col("_provider").isin(*books), "no source").when(F.col("_book").isNull(), "not found").otherwise("found")
    return told.select(*ids.columns, state.alias("state"), *(F.col(f"_book.{c}").alias(c) for c in values))


@dataclass
class Snapshot:
    """A source over stored answers."""

    name: str
    shape: Callable[[DataFrame], DataFrame]

    def candidates(self, answers: DataFrame) -> DataFrame:
        return self.shape(answers)


@dataclass
class Registry:
    """Sources in order of registration."""

    sources: list[Source] = field(default_factory=list)

    def register(self, source: Source) -> None:
        self.sources.append(source)

    def get(self, name: str) -> Source | None:
        return next((s for s in self.sources if s.name == name), None)

    def fan_out(self, answers: dict[str, DataFrame]) -> DataFrame:
        """All sources' candidates with provider_pos; a source without answers adds nothing."""
        parts = [s.candidates(answers[s.name]).withColumn("provider_pos", F.lit(i)) for i, s in enumerate(self.sources) if s.name in answers]
        return reduce(DataFrame.unionByName, parts)


def default_registry() -> Registry:
    return Registry([Snapshot(f.__name__, f) for f in (audible, hardcover, apple, storytel, overdrive, openlibrary)])
