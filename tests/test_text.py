import pytest
from pyspark.sql import functions as F

from folioforge.functions import languages as L
from folioforge.functions import text as T


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


TITLES = {
    "Peace Talks: Dresden Files, Book 16": "Peace Talks",
    "Cube Route (Xanth #27)": "Cube Route",
    "Dresden Files, Book 16: Peace Talks": "Peace Talks",
    "DW23 - Carpe Jugulum": "Carpe Jugulum",
    "01 - Title": "Title",
    "11-22-63": "11-22-63",
    "11 - 22-63": "22-63",
    "1984": "1984",
    "01 The Stars, Like Dust": "The Stars, Like Dust",
    "[The Expanse 0.5] Drive": "Drive",
    "Some_Title (Unabridged)": "Some Title",
    "Fahrenheit 451": "Fahrenheit 451",
    "Catch-22, Book 3": "Catch",
}


def test_normalize_title(spark):
    assert one(spark, T.normalize_title, *TITLES, None, "") == [*TITLES.values(), "", ""]


def test_ids(spark):
    raw = "Demons [B0CJRV5S7M]", "A Spell (B123456789) [Xanth 1]", "No id [x]", None
    assert one(spark, T.bracketed_asin, *raw) == ["B0CJRV5S7M", "B123456789", None, None]
    assert one(spark, T.without_edge_brackets, *raw) == ["Demons", "A Spell (B123456789)", "No id", ""]
    ids = "hardcover-edition-31", "openlibrary-works-OL8W", "storytel-14", "apple-audiobook-15", "overdrive-26", "B0CJRV5S7M", "apple-audiobook-x", ""
    assert one(spark, T.decode_id, *ids) == [("hardcover", "edition", "31"), ("openlibrary", "works", "/works/OL8W"), ("storytel", "book", "14"), ("apple", "audiobook", "15"), ("overdrive", "media", "26"), None, None, None]


def test_clean_and_bases(spark):
    assert one(spark, T.clean, "Éric & Søn, 2", "日本", "NFD é") == ["eric  sn 2", "", "nfd e"]
    assert one(spark, T.base_title, "Dune: Part (x)", "Dune (x): y", "Dune") == ["Dune", "Dune", "Dune"]
    assert one(spark, T.base_title_dashed, "Dune - Part one", "A-B: c") == ["Dune", "A-B"]
    assert one(spark, T.without_article, "The Taggerung", "Anansi", "The") == ["Taggerung", "Anansi", "The"]
    assert one(spark, T.unify_ampersand, "Faun&Games", "Faun & Games") == ["Faun and Games"] * 2


def test_names(spark):
    assert one(spark, T.split_authors, "A Sanderson, B; C/D & E and F", "", None) == [["A Sanderson, B; C/D & E and F", "A Sanderson", "B", "C", "D", "E", "F"], [""], [""]]
    assert one(spark, T.initials, "Stephen R. Lawhead", "J. R. R. Tolkien", "Plain Name") == ["r", "rr", ""]
    assert one(spark, T.without_initials, "Stephen R. Lawhead", "Ann Bee", "Mary Ann Lee") == ["stephen lawhead", "ann bee", "mary ann lee"]
    assert one(spark, T.volume_numbers, "KTF Part 2", "Galaxy's Edge, Book 7: KTF Part 2", "Brand#17", "The Book Thief", None) == [[2], [7, 2], [17], [], []]


def test_chapters_and_case(spark):
    assert one(spark, lambda c: T.chapter_title(c, F.lit("Kapitel")), "1", "001", "Chapter_12", "Chapter 1.", "1234", ".") == ["Kapitel 1", "Kapitel 1", "Kapitel 12", "Chapter 1", "1234", "Kapitel NaN"]
    assert one(spark, T.title_case, "Cube route", "heaven of the cent", "iPhone Story", "") == ["Cube Route", "Heaven of the Cent", "iPhone Story", ""]


def test_descriptions(spark):
    assert one(spark, T.cleanup_description, "Mail me@x.com now", "by @author now", "see https://a.b/c?d e") == ["Mail  now", "by now", "see  e"]
    assert one(spark, T.strip_html, "<p>a &amp; b<br/>c</p>", "<p></p>", None) == ["a & b\nc", None, None]
    assert one(spark, T.copyright_year, "©2018 X (P)2019", "(c) 1999 Y", "none") == [2018, 1999, None]
    assert one(spark, T.square_cover, "https://i/x/100x100bb.jpg", "https://i/x.jpg") == ["https://i/x/600x600bb.jpg", None]


@pytest.mark.parametrize("f,yes,no", [(T.is_bundle, "Drow Gift Set", "The Setting"), (T.is_bundle, "Books 1-4", "Book 1"), (T.is_foreign_edition, "Everfound (Spanish Edition)", "Spanish Steps")])
def test_markers(spark, f, yes, no):
    assert one(spark, f, yes, no, None) == [True, False, False]


def test_languages(spark):
    raw = "English", "Deutsch", "fra", "en-GB", "Brazilian Portuguese", "it", "say it", "islenska", "nb", "Norwegian Bokmål", "xx1", "", None
    assert one(spark, L.normalize_language, *raw) == ["en", "de", "fr", "en", "pt", "it", None, "is", "no", "no", None, None, None]
    assert one(spark, L.region_language, "us", "JP", "mars", None) == ["en", "ja", None, None]
