"""Nested source documents to catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_asin

#: Target schema of a book record.
BOOK = (
    "asin string, authors array<struct<asin:string,name:string>>, copyright int, description string, formatType string, genres array<struct<asin:string,name:string,type:string>>, image string,"
    " isAdult boolean, isbn string, language string, literatureType string, narrators array<struct<asin:string,name:string>>, publisherName string, rating string, region string, releaseDate timestamp,"
    " runtimeLengthMin int, seriesPrimary struct<asin:string,name:string,position:string>, seriesSecondary struct<asin:string,name:string,position:string>, subtitle string, summary string, title string"
)
#: Schema of a raw product document.
PRODUCT = (
    "asin string, authors array<struct<asin:string,name:string>>, narrators array<struct<asin:string,name:string>>, category_ladders array<struct<ladder:array<struct<id:string,name:string>>,root:string>>,"
    " content_delivery_type string, content_type string, copyright string, format_type string, is_adult_product boolean, isbn string, issue_date string, language string, merchandising_summary string,"
    " product_images map<string,string>, publication_name string, publisher_name string, publisher_summary string, rating struct<overall_distribution:struct<display_average_rating:string>>, release_date string,"
    " runtime_length_min int, series array<struct<asin:string,title:string,sequence:string>>, subtitle string, thesaurus_subject_keywords array<string>, title string"
)
CHAPTERS = "brandIntroDurationMs long, brandOutroDurationMs long, chapters array<struct<length_ms:long,start_offset_ms:long,start_offset_sec:long,title:string>>, is_accurate boolean, runtime_length_ms long, runtime_length_sec long"


def duration_seconds(c: Column) -> Column:
    """HH:MM:SS or MM:SS in seconds; null where not numeric or not above zero."""
    parts = F.transform(F.split(c, ":"), lambda x: x.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when(total > 0, total.cast("long"))


def text_or_field(c: Column, field: str) -> Column:
    """A value given bare or as a field of an object."""
    return F.coalesce(F.get_json_object(F.when(c.startswith("{"), c), f"$.{field}"), F.when(~c.startswith("{"), c))


def distinct_last(items: Column, key: str) -> Column:
    """One item per key: the place of its first, the value of its last."""
    keys = F.array_distinct(F.transform(items, lambda x: x[key]))
    return F.transform(keys, lambda k: F.element_at(F.filter(items, lambda x: x[key] == k), -1))


def by_role(people: Column, role: str, narrators: bool) -> Column:
    """Those of people whose role says that they narrate, or all others."""
    told = lambda p: F.coalesce(F.lower(p[role]).contains("narrat"), F.lit(False))
    return F.filter(people, told if narrators else lambda p: ~told(p))


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left's records with right's fields over them, null or not, where right has the key."""
    over = right.select(F.col(key).alias("_key"), *(F.col(x).alias(f"_{x}") for x in right.columns if x != key), F.lit(True).alias("_in"))
    both = left.join(over, left[key] == over["_key"], "left")
    return both.select(*(F.when(F.col("_in"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in right.columns and x != key else F.col(x) for x in left.columns))


def with_page_genres(records: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """records (key, genres) with the genres of their pages where they have none of their own."""
    read = pages.select(key, F.col("genres").alias("_page"))
    none = F.coalesce(F.size("genres"), F.lit(0)) <= 0
    return records.join(read, key, "left").withColumn("genres", F.when(none, F.col("_page")).otherwise(F.col("genres"))).drop("_page")


def genres(ladders: Column) -> Column:
    """The first step of each ladder, distinct by name."""
    first = F.filter(F.transform(ladders, lambda x: F.get(x["ladder"], F.lit(0))), lambda x: x["name"].isNotNull() & x["id"].rlike(r"^\d{10,12}$"))
    return F.transform(distinct_last(first, "name"), lambda x: F.struct(x["id"].alias("asin"), x["name"].alias("name"), F.lit("genre").alias("type")))


def tags(ladders: Column) -> Column:
    """All further steps, distinct by name."""
    rest = F.flatten(F.transform(ladders, lambda x: F.slice(x["ladder"], 2, 1000)))
    kept = F.filter(rest, lambda x: x["name"].isNotNull() & x["id"].rlike(r"^\d{10,12}$"))
    return F.transform(distinct_last(kept, "name"), lambda x: F.struct(x["id"].alias("asin"), x["name"].alias("name"), F.lit("tag").alias("type")))


def series(items: Column, publication: Column) -> tuple[Column, Column]:
    """Primary: the last named like the publication; secondary: the last named otherwise, where there are several and a primary."""
    shaped = F.transform(items, lambda s: F.struct(s["asin"].alias("asin"), s["title"].alias("name"), s["sequence"].alias("position")))
    same, other = F.filter(shaped, lambda s: s["name"] == publication), F.filter(shaped, lambda s: s["name"] != publication)
    primary = F.try_element_at(same, F.lit(-1))
    return primary, F.when(primary.isNotNull() & (F.size(items) > 1), F.try_element_at(other, F.lit(-1)))


def cover(images: Column) -> Column:
    """The larger of the two listed sizes, without its size token."""
    url = F.coalesce(F.try_element_at(images, F.lit("1024")), F.try_element_at(images, F.lit("500")))
    return F.regexp_replace(url, r"\._[A-Za-z0-9_,-]+_(?=\.)", "")


def largest(images: Column) -> Column:
    """The url of the greatest numeric key; the first of equals."""
    entries = F.map_entries(images)
    top = F.array_max(F.transform(entries, lambda e: e["key"].cast("int")))
    return F.get(F.filter(entries, lambda e: e["key"].cast("int") == top), F.lit(0))["value"]


def product_issues() -> Column:
    """What keeps a product from being a record, first things first; empty if sound."""
    c = F.col
    checks = [
        (~is_asin(c("asin")) & ~F.coalesce(c("asin").rlike(r"^\d{9}[\dX]$"), F.lit(False)), "asin"),
        (F.coalesce(F.size("authors"), F.lit(0)) <= 0, "authors"),
        (c("title").isNull() | (c("title") == ""), "title"),
        (c("language").isNull(), "language"),
        (c("rating.overall_distribution.display_average_rating").isNull(), "rating"),
        (F.coalesce("release_date", "issue_date").isNull(), "release_date"),
    ]
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)), lambda x: x.isNotNull())


def books(raw: DataFrame, region: str = "us") -> tuple[DataFrame, DataFrame]:
    """(valid book records, quarantined rows with their issues) of raw JSON (json)."""
    parsed = raw.select("json", F.from_json("json", PRODUCT).alias("p")).select("json", "p.*").withColumn("issues", product_issues())
    good, bad = parsed.filter(F.size("issues") == 0), parsed.filter(F.size("issues") > 0).select("json", "asin", "issues")
    primary, secondary = series(F.col("series"), F.col("publication_name"))
    ladders = F.col("category_ladders")
    fiction = F.exists("thesaurus_subject_keywords", lambda k: k.contains("fiction"))
    from ..functions.text import copyright_year, strip_html

    return good.select(
        "asin", "authors", copyright_year(F.col("copyright")).alias("copyright"), strip_html(F.col("merchandising_summary")).alias("description"), F.col("format_type").alias("formatType"),
        F.concat(genres(ladders), tags(ladders)).alias("genres"), cover(F.col("product_images")).alias("image"), F.coalesce("is_adult_product", F.lit(False)).alias("isAdult"), "isbn", "language",
        F.when(F.coalesce(fiction, F.lit(False)), "fiction").otherwise("nonfiction").alias("literatureType"), "narrators", F.col("publisher_name").alias("publisherName"),
        F.col("rating.overall_distribution.display_average_rating").alias("rating"), F.lit(region).alias("region"), F.coalesce("release_date", "issue_date").try_cast("timestamp").alias("releaseDate"),
        F.coalesce("runtime_length_min", F.lit(0)).alias("runtimeLengthMin"), primary.alias("seriesPrimary"), secondary.alias("seriesSecondary"), "subtitle", F.col("publisher_summary").alias("summary"), "title",
    ), bad


def chapters(raw: DataFrame, word: Column) -> DataFrame:
    """asin and its chapter record of raw JSON (asin, json)."""
    from ..functions.text import chapter_title

    c = F.from_json("json", CHAPTERS)
    return raw.select("asin", c.alias("c")).select(
        "asin", "c.brandIntroDurationMs", "c.brandOutroDurationMs",
        F.transform("c.chapters", lambda x: F.struct(x["length_ms"].alias("lengthMs"), x["start_offset_ms"].alias("startOffsetMs"), x["start_offset_sec"].alias("startOffsetSec"), chapter_title(x["title"], word).alias("title"))).alias("chapters"),
        F.col("c.is_accurate").alias("isAccurate"), F.col("c.runtime_length_ms").alias("runtimeLengthMs"), F.col("c.runtime_length_sec").alias("runtimeLengthSec"),
    )


def json_ld_audiobook(html: Column) -> Column:
    """The first embedded linked-data block of an audiobook, as text; unreadable blocks are passed over."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    flat = F.flatten(F.transform(found, lambda b: F.coalesce(F.from_json(b, "array<string>"), F.array(b))))
    return F.get(F.filter(flat, lambda b: F.lower(F.get_json_object(b, "$['@type']")) == "audiobook"), F.lit(0))


def category_links(html: Column) -> Column:
    """Links to category and tag pages as (href, name, type)."""
    anchors = F.regexp_extract_all(html, F.lit(r"<a[^>]*href=\"([^\"]*/(?:cat|tag)/[^\"]*)\"[^>]*>[^<]*</a>"), F.lit(0))
    return F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r'href="([^"]*)"', 1).alias("href"), F.regexp_extract(a, r">([^<]*)</a>", 1).alias("name"), F.when(a.contains("/tag/"), "genre").otherwise("tag").alias("type")))
