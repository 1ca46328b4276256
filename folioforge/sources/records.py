"""Full records of provider documents: what a matched candidate's own page says, in one shape.

Answers carry one provider document each, as for candidates; `by_id` takes the
documents behind native ids.  RECORD is the shape of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..operators.records import by_role, json_ld_audiobook, text_or_field
from .providers import _names

RECORD = ("id", "asin", "title", "subtitle", "authors", "narrators", "summary", "image", "publisher", "language", "rating", "release_date", "series_primary", "series_secondary")
SERIES = "struct<name:string,position:string>"
MOST_AUTHORS = 4
COVERS = "https://covers.openlibrary.org/b/id/"


def by_id(documents: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The documents of the wanted keys, one of each, the first by `item_pos` where there are several."""
    mine = documents.join(wanted.select(key).distinct(), key, "left_semi")
    return mine.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("item_pos"))).filter("_r = 1").drop("_r")


def by_name(documents: DataFrame, name: str, wanted: DataFrame, most: int = 5) -> DataFrame:
    """The first documents of each wanted name, the name exact."""
    mine = documents.join(wanted.select(name).distinct(), name, "left_semi")
    return mine.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("item_pos"))).filter(F.col("_r") <= most).drop("_r")


def _record(df: DataFrame, **values: Column) -> DataFrame:
    kinds = {"authors": "array<string>", "narrators": "array<string>", "series_primary": SERIES, "series_secondary": SERIES}
    return df.select(*(values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RECORD))


def _series(name: Column, position: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.struct(name.alias("name"), position.alias("position")))


def hardcover(df: DataFrame) -> DataFrame:
    """Books (id, title, subtitle, description, rating, contributions, cached_image, book_series, editions) with their first spoken edition, else their first."""
    spoken = F.filter("editions", lambda e: (e["reading_format_id"] == 2) & (e["audio_seconds"] > 0))
    df = df.withColumn("ed", F.coalesce(F.get(spoken, F.lit(0)), F.get("editions", F.lit(0))))
    people = lambda c, narrators: _names(F.transform(by_role(c, "contribution", narrators), lambda x: x["author"]))
    ed = F.col("ed")
    named = F.filter("book_series", lambda s: F.coalesce(s["series"]["name"], F.lit("")) != "")
    series = lambda i: _series(F.get(named, F.lit(i))["series"]["name"], T.number_text(F.get(named, F.lit(i))["position"]))
    return _record(
        df, id=F.concat(F.lit("hardcover-book-"), F.col("id").cast("string")), asin=ed["asin"], title=F.coalesce("title", F.lit("")), subtitle=F.col("subtitle"), authors=people(F.col("contributions"), False), narrators=people(ed["contributions"], True),
        summary=F.col("description"), image=F.coalesce(ed["cached_image"]["url"], F.col("cached_image.url")), publisher=ed["publisher"]["name"], language=L.normalize_language(ed["language"]["language"]), rating=F.format_string("%.2f", F.col("rating").cast("double")),
        release_date=ed["release_date"], series_primary=series(0), series_secondary=series(1),
    )


def apple(df: DataFrame) -> DataFrame:
    """Store documents (collectionId, collectionName, artistName, artworkUrl100, description, copyright, releaseDate, html); html is the linked page, whose embedded data comes first."""
    ld = json_ld_audiobook(F.coalesce("html", F.lit("")))
    said = F.get_json_object(ld, "$.readBy")
    read = F.when(said.startswith("["), F.from_json(said, "array<string>")).when(said != "", F.array(said)).otherwise(F.array().cast("array<string>"))
    good = df.filter("coalesce(collectionName, '') != ''")
    artist = F.when(F.coalesce("artistName", F.lit("")) != "", F.array("artistName")).otherwise(F.array().cast("array<string>"))
    return _record(
        good, id=F.concat(F.lit("apple-audiobook-"), F.col("collectionId").cast("string")), title=T.clean_store_title(F.col("collectionName")), authors=artist, narrators=F.filter(read, lambda n: F.coalesce(n, F.lit("")) != ""),
        summary=T.strip_html(F.coalesce(F.get_json_object(ld, "$.description"), F.col("description"))), image=T.square_cover(F.col("artworkUrl100")), publisher=T.publisher_of_copyright(F.col("copyright")),
        release_date=F.coalesce(F.get_json_object(ld, "$.datePublished"), F.col("releaseDate")),
    )


def storytel(df: DataFrame, base: str = "https://www.storytel.com") -> DataFrame:
    """Documents with book and abook; the first named series."""
    book, abook = F.col("book"), F.col("abook")
    series = F.get(F.filter(book["series"], lambda s: F.coalesce(s["name"], F.lit("")) != ""), F.lit(0))["name"]
    path = F.nullif(book["largeCover"], F.lit(""))
    return _record(
        df.filter("coalesce(book.name, '') != ''"), id=F.concat(F.lit("storytel-"), book["consumableId"].cast("string")), title=book["name"], authors=_names(book["authors"]), narrators=_names(abook["narrators"]), summary=abook["description"],
        image=F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), path)), publisher=abook["publisher"], language=L.normalize_language(book["language"]["isoValue"]), release_date=abook["releaseDate"],
        series_primary=_series(series, T.number_text(book["seriesOrder"])),
    )


def overdrive(df: DataFrame) -> DataFrame:
    """Library media (id, title, creators, description, covers, publisher, starRating, publishDate, series, detailedSeries, languages); title and publisher bare or in an object."""
    title = text_or_field(F.col("title"), "main")
    role = lambda r: _names(F.filter("creators", lambda c: F.lower(F.coalesce(c["role"], F.lit(""))) == r))
    covers = F.filter(F.map_values("covers"), lambda c: F.coalesce(c["href"], F.lit("")) != "")
    widest = F.array_max(F.transform(covers, lambda c: F.coalesce(c["width"], F.lit(0))))
    cover = F.get(F.filter(covers, lambda c: F.coalesce(c["width"], F.lit(0)) == widest), F.lit(0))["href"]
    tongue = F.get("languages", F.lit(0))
    return _record(
        df.filter(F.coalesce(title, F.lit("")) != ""), id=F.concat(F.lit("overdrive-"), F.col("id").cast("string")), title=title, authors=role("author"), narrators=role("narrator"), summary=T.strip_html(F.col("description"), paragraphs=True), image=cover,
        publisher=text_or_field(F.col("publisher"), "name"), language=L.normalize_language(F.coalesce(tongue["id"], tongue["name"])), rating=T.number_text(F.col("starRating")), release_date=F.col("publishDate"),
        series_primary=_series(F.coalesce("detailedSeries.seriesName", "series"), F.nullif(F.col("detailedSeries.readingOrder"), F.lit(""))),
    )


def openlibrary(df: DataFrame, authors: DataFrame) -> DataFrame:
    """Works (key, title, description, authors, covers) with the names (key, name) behind their first author keys, in order, those unknown left out."""
    works = df.filter("coalesce(title, '') != ''")
    keys = works.select(F.col("key").alias("work"), F.posexplode(F.slice(F.filter(F.transform("authors", lambda a: a["author"]["key"]), lambda k: F.coalesce(k, F.lit("")) != ""), 1, MOST_AUTHORS)).alias("i", "author"))
    named = keys.join(authors.select(F.col("key").alias("author"), "name").filter("coalesce(name, '') != ''"), "author").groupBy("work").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("found"))
    cover = F.get(F.filter("covers", lambda c: c > 0), F.lit(0))
    both = works.join(named, works["key"] == named["work"], "left")
    people = F.coalesce(F.transform("found", lambda x: x["name"]), F.array().cast("array<string>"))
    return _record(
        both, id=F.concat(F.lit("openlibrary-works-"), F.regexp_replace("key", r"^/?works/", "")), title=T.title_case(F.col("title")), authors=people, narrators=F.array().cast("array<string>"), summary=text_or_field(F.col("description"), "value"),
        image=F.when(cover.isNotNull(), F.concat(F.lit(COVERS), cover.cast("string"), F.lit("-L.jpg"))),
    )


def search_with_stem(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """wanted (query_id, title) with documents (title_key, ..) of the whole title, and where there are none of its stem before a subtitle."""
    whole = wanted.select("query_id", F.lower("title").alias("title_key"))
    hit = whole.join(documents, "title_key").withColumn("how", F.lit("title"))
    stem = F.lower(T.base_title(F.col("title")))
    missed = wanted.join(hit.select("query_id").distinct(), "query_id", "left_anti").filter((stem != "") & (stem != F.lower("title"))).select("query_id", stem.alias("title_key"))
    return hit.unionByName(missed.join(documents, "title_key").withColumn("how", F.lit("stem")))
