"""Authors: their pages, portraits and biographies, and the search for them by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import with_similarity
from ..functions.text import asin_of_url, clean_biography, cleanup_description, html_text, normalize_name, strip
from ..sources.tables import cut_lineage
from .enrich import collapse_initials, one_per_name, same_author
from .text_index import TextIndex

NAME_FLOOR, TEXT_HITS, HIT_DEPTH = 0.7, 25, 5
#: What is no portrait, no biography, no name.
NO_PHOTO, NO_BIOGRAPHY, NO_NAME = r"(?i)/nophoto/", "N/A", "Showing titles\n in All Categories"
#: What marks a book's page.
BOOK_PARTS, BOOK_CLASS, SAMPLE, SAMPLE_LABEL, TITLE_CLASS, BOLD_CLASS = "buy-button|sample-button|chapter-list", "product-listener", "Sample", "bc-button-text", "bc-heading", "bc-text-bold"
#: Places of an author's page.
NAME_AT = r'(?is)<h1[^>]*class="[^"]*\bbc-heading\b[^"]*\bbc-text-bold\b[^"]*"[^>]*>(.*?)</h1>'
ABOUT_AT = r'(?is)<div[^>]*class="[^"]*\bbc-expander-content\b[^"]*"[^>]*>(.*?)</div>'
IMAGE_AT = r'(?is)<img[^>]*class="[^"]*\bauthor-image-outline\b[^"]*"[^>]*>'
SIMILAR_AT = r'(?is)<a[^>]*class="[^"]*\bbc-link bc-color-link\b[^"]*"[^>]*>.*?</a>'
THUMBNAIL = "__01_SX120_CR0,0,120,120__."


def _of_class(name: str) -> str:
    """A class attribute with this among its names, however it is quoted."""
    return rf"""\s(?i:class)\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>]))"""


def _inside(html: Column, tag: str, attribute: str = "") -> Column:
    """The markup inside each element of this kind, up to the first end of its name."""
    found = rf"(?s)<((?i:{tag}))(?=[\s>]){'[^<>]*?' + attribute if attribute else ''}[^<>]*>((?:(?!</(?i:\1)[\s>]).)*)"
    return F.regexp_extract_all(html, F.lit(found), F.lit(2))


def is_book_page(html: Column) -> Column:
    """Whether a page has a book's parts in its markup; what its text, comments and scripts say doesn't count."""
    page = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    any_tag = "[a-z][a-z0-9-]*"
    part = page.rlike(rf"""<[a-zA-Z][^<>]*?\s(?i:data-testid)\s*=\s*(?:"(?:{BOOK_PARTS})"|'(?:{BOOK_PARTS})'|(?:{BOOK_PARTS})(?=[\s>]))""")
    bold = F.exists(_inside(page, "h1", _of_class(TITLE_CLASS)), lambda x: x.rlike(rf"<[a-zA-Z][^<>]*?{_of_class(BOLD_CLASS)}"))
    says = lambda x: F.regexp_replace(x, "<[^>]*>", "").contains(SAMPLE)
    sample = F.exists(_inside(page, "button"), says) | F.exists(_inside(page, any_tag, _of_class(SAMPLE_LABEL)), says)
    return F.coalesce(part | page.rlike(rf"<[a-zA-Z][^<>]*?{_of_class(BOOK_CLASS)}") | bold | sample, F.lit(False))


def similar_authors(html: Column) -> Column:
    """Similar authors (asin, name) in the order of names as people read them."""
    links = F.regexp_extract_all(html, F.lit(SIMILAR_AT), F.lit(0))
    shaped = F.transform(links, lambda a, i: F.struct(F.collate(html_text(F.regexp_extract(a, r"(?is)<h3[^>]*>(.*?)</h3>", 1)), "UNICODE").alias("key"), i.alias("i"), asin_of_url(F.regexp_extract(a, r'(?i)href="([^"]*)"', 1)).alias("asin")))
    return F.transform(F.array_sort(shaped), lambda x: F.struct(x["asin"].alias("asin"), F.collate(x["key"], "UTF8_BINARY").alias("name")))


def author_pages(pages: DataFrame, region: str = "us") -> DataFrame:
    """asin, state, name, description, image, similar, region of pages (asin, status, html).

    state: ok, NOT_FOUND (no page), book (a book's page), REGION_UNAVAILABLE.
    """
    html = F.coalesce("html", F.lit(""))
    name = strip(html_text(F.regexp_extract(html, NAME_AT, 1)))
    image = F.replace(F.regexp_extract(F.regexp_extract(html, IMAGE_AT, 0), r'(?i)\bsrc="([^"]*)"', 1), F.lit(THUMBNAIL), F.lit(""))
    read = pages.select("asin", "status", html.alias("html"), name.alias("name"), cleanup_description(html_text(F.regexp_extract(html, ABOUT_AT, 1))).alias("description"), image.alias("image"), similar_authors(html).alias("similar"))
    usable = (F.col("name") != "") & (F.col("name") != NO_NAME)
    state = F.when(F.col("status").isin(403, 404, 503), "NOT_FOUND").when(usable, "ok").when(is_book_page(F.col("html")), "book").otherwise("REGION_UNAVAILABLE")
    return read.select("asin", state.alias("state"), "name", "description", "image", "similar", F.lit(region).alias("region"))


def minimal_profiles(gone: DataFrame, old: DataFrame) -> DataFrame:
    """Profiles of authors (asin, name) whose page is gone: the name given, all else as it was before, or empty."""
    kept = old.select("asin", *(F.col(c).alias(f"_{c}") for c in ("description", "image", "image_alt")))
    return gone.join(kept, "asin", "left").select("asin", "name", *(F.coalesce(f"_{c}", F.lit("")).alias(c) for c in ("description", "image", "image_alt")))


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).isNotNull()


def info_of_rows(rows: DataFrame) -> DataFrame:
    """name, image, bio from rows of one source (name, row_name, image, bio, pos).

    Image: of rows with one the first of exactly this name, else the first.
    Biography: of rows of exactly this name, else of all, the longest, cleaned.
    """
    other = F.lower("row_name") != F.lower("name")
    other = F.coalesce(other, F.lit(True))
    image = F.when(F.col("image") != "", F.col("image"))
    picks = rows.groupBy("name").agg(
        F.min_by(image, F.when(image.isNotNull(), F.struct(other.alias("other"), "pos"))).alias("image"),
        F.min_by("bio", F.when(_said(F.col("bio")), F.struct(other.alias("other"), (-F.length("bio")).alias("shorter"), "pos"))).alias("bio"),
    )
    return picks.withColumn("bio", clean_biography(F.col("bio")))


def info_of_hits(hits: DataFrame, authors: DataFrame) -> DataFrame:
    """name, image, bio from the authors behind book hits (name, pos, author), by records (author, author_name, image, bio).

    Of the first HIT_DEPTH hits' authors, in order, the first who is the same
    person and has a portrait or a biography; placeholders count as neither.
    """
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("pos"))).filter(F.col("_r") <= HIT_DEPTH)
    ids = first.filter("author IS NOT NULL").groupBy("name", "author").agg(F.min("pos").alias("pos"))
    known = same_author(ids.join(authors, "author"), "name", "author_name", "same").filter("same")
    image = F.when(_said(F.col("image")) & ~F.col("image").rlike(NO_PHOTO), F.col("image"))
    bio = F.when(_said(F.col("bio")) & (F.trim("bio") != NO_BIOGRAPHY), F.trim("bio"))
    found = known.select("name", "pos", image.alias("image"), bio.alias("bio")).filter("image IS NOT NULL OR bio IS NOT NULL")
    return found.groupBy("name").agg(F.min_by(F.struct("image", "bio"), "pos").alias("x")).select("name", "x.image", "x.bio")


def text_hits(wanted: DataFrame, known: DataFrame, most: int = TEXT_HITS) -> DataFrame:
    """wanted (query) with the known authors (asin, name, ..) that share words with it, those with most shared words first: score, pos."""
    found = TextIndex(known, "asin", "name").search(wanted, most)
    return found.withColumnRenamed("key", "asin").join(known, "asin")


def catalogue_authors(products: DataFrame, asked: DataFrame | None = None, within: str = "query") -> DataFrame:
    """query, asin, name, pos: authors of products (within, product, pos, authors) whose names are near enough to the query.

    asked: the queries (query, within) of each catalogue, where products don't
    name their own.  Products are counted for each author and name before queries
    meet them, and names are compared once for each catalogue, so only counts of
    authors who are near a query are taken per query.  An author counts once per
    product; of authors of one name the one with most products stays, the
    earlier of equals; most products first.
    """
    people = products.select(within, "product", "pos", F.posexplode("authors").alias("i", "a")).select(within, "product", F.struct("pos", "i").alias("at"), "a.asin", "a.name").filter("coalesce(asin, '') != '' AND coalesce(name, '') != ''")
    # What an author is called in a product; nearly always one name, so authors are counted by it, and by all of them where there are more.
    rows = people.groupBy("product", "asin", *([within] if asked is None else [])).agg(F.collect_list(F.struct(F.struct(within, "name").alias("called"), "at")).alias("rows"))
    names = F.array_sort(F.array_distinct(F.transform("rows", lambda x: x["called"])))
    places = F.transform("names", lambda n: F.struct(n.alias("called"), F.transform(F.filter("rows", lambda x: x["called"].eqNullSafe(n)), lambda x: x["at"]).alias("at")))
    each = rows.withColumn("names", names).select("product", "asin", F.when(F.size("names") > 1, F.col("names")).alias("names"), F.explode(places).alias("x"))
    each = each.select("product", "asin", "names", "x.called.*", F.array_min("x.at").alias("first"), F.array_max("x.at").alias("last"))
    # A table, so products are read once; it has a row or few of each author, however many products and queries there are.
    counts = cut_lineage(each.groupBy("asin", within, "name", "names").agg(F.count("product").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")))
    wanted = counts.select(within, "name").distinct()
    wanted = wanted if asked is None else wanted.join(asked, within)
    # A table: few rows, which meet many of a hot name.
    close = cut_lineage(with_similarity(wanted, "query", "name", "sim").filter(F.col("sim") >= NAME_FLOOR).select(*dict.fromkeys((within, "query", "name"))).distinct())
    near = counts.join(close, [within, "name"]).withColumn("names", F.coalesce("names", F.array(F.struct(within, "name"))))
    # Of names that stand together in products several may be near; these products count once.
    near = near.groupBy("query", "asin", "names").agg(F.max("n").alias("n"), F.max_by("name", "last").alias("name"), F.min("first").alias("first"), F.max("last").alias("last"))
    counted = near.groupBy("query", "asin").agg(F.sum("n").alias("n"), F.max_by("name", "last").alias("name"), F.min("first").alias("at"))
    named = counted.groupBy("query", normalize_name(F.col("name")).alias("key")).agg(F.min(F.struct((-F.col("n")).alias("fewer"), "at", "asin", "name")).alias("best"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("best.fewer", "first"))
    return named.select("query", "best.asin", "best.name", place.alias("pos"))


def search_authors(wanted: DataFrame, known: DataFrame, products: DataFrame) -> DataFrame:
    """query, asin, name, pos, how: close matches among known authors, each person once; where there are none, the catalogue's."""
    # Tables, as names are compared by many patterns, and what is close is asked for twice.
    hits = cut_lineage(same_author(cut_lineage(text_hits(wanted, known)), "query", "name", "same").filter("same").drop("same"))
    close = cut_lineage(collapse_initials(one_per_name(hits, ["query"]), ["query"]))
    shape = lambda d, how: d.select("query", "asin", "name", F.col("pos").cast("long").alias("pos"), F.lit(how).alias("how"))
    missed = products.join(close.select("query").distinct(), "query", "left_anti")
    return shape(close, "known").unionByName(shape(catalogue_authors(missed), "catalogue"))
