from folioforge.sources.providers import default_registry, dispatch, library_page

ANSWERS = {
    "audible": ("query_id long, region string, item_pos int, asin string, title string, authors array<struct<name:string>>, narrators array<struct<name:string>>, runtime_length_min int, product_images map<string,string>, language string",
                [(1, "us", 0, "B000000001", "Dune", [("Ann",), (None,)], None, 10, {"500": "s", "1024": "l"}, "english"), (1, "us", 1, None, "x", None, None, None, None, None)]),
    "hardcover": ("query_id long, region string, item_pos int, id long, title string, contributions array<struct<author:struct<name:string>,contribution:string>>, cached_image struct<url:string>, editions array<struct<id:long,asin:string,audio_seconds:int,contributions:array<struct<author:struct<name:string>,contribution:string>>,cached_image:struct<url:string>,language:struct<language:string>>>",
                  [(1, "us", 0, 7, "Dune", [(("Ann",), None)], ("b",), [(1, None, 600, [(("Ned",), "Narrator")], None, ("German",)), (2, "B1", 660, [(("Nia",), "Narrated by")], ("e",), None)]), (1, "us", 1, 8, "Xanth", [(("Bob",), None)], None, [])]),
    "apple": ("query_id long, region string, item_pos int, collectionId long, collectionName string, artistName string, artworkUrl100 string", [(1, "us", 0, 5, "Dune (Unabridged)", "Ann", "http://i/1/100x100bb.jpg"), (1, "us", 1, None, "x", None, None)]),
    "storytel": ("query_id long, region string, item_pos int, book struct<name:string,consumableId:string,authors:array<struct<name:string>>,largeCover:string,language:struct<isoValue:string>>, abook struct<narrators:array<struct<name:string>>,length:long>",
                 [(1, "us", 0, ("Dune", "14", [("Ann",)], "/c.jpg", ("en",)), ([("Ned",)], 1500)), (1, "us", 1, ("Ebook", "15", None, None, ("en",)), None), (1, "us", 2, ("Düne", "16", None, None, ("de",)), (None, 0))]),
    "overdrive": ("query_id long, region string, item_pos int, id string, title string, creators array<struct<name:string,role:string>>, formats array<struct<id:string,duration:string>>, covers map<string,struct<href:string,width:int>>, languages array<struct<id:string,name:string>>",
                  [(1, "us", 0, "9", '{"main":"Dune"}', [("Ann", "Author"), ("Ned", "Narrator")], [("a", None), ("b", "00:10:00")], {"x": ("small", 10), "y": ("wide", 90)}, [("en", "English")])]),
    "openlibrary": ("query_id long, region string, item_pos int, key string, title string, author_name array<string>, cover_i long, language array<string>", [(1, "us", 0, "/works/OL1W", "Cube route", ["Ann"], 3, ["eng"])]),
}


def test_all_sources_in_one_shape(spark):
    registry = default_registry()
    out = registry.fan_out({n: spark.createDataFrame(rows, schema) for n, (schema, rows) in ANSWERS.items()}).orderBy("provider_pos", "item_pos").collect()
    got = [(r.provider, r.id, r.asin, r.title, r.authors, r.narrators, r.audio_seconds, r.cover, r.language) for r in out]
    assert got == [
        ("audible", "B000000001", "B000000001", "Dune", ["Ann"], [], 600.0, "l", "en"),
        ("hardcover", "hardcover-edition-2", "B1", "Dune", ["Ann"], ["Nia"], 660.0, "e", None),
        ("hardcover", "hardcover-book-8", None, "Xanth", ["Bob"], [], None, None, None),
        ("apple", "apple-audiobook-5", None, "Dune", ["Ann"], [], None, "http://i/1/600x600bb.jpg", None),
        ("storytel", "storytel-14", None, "Dune", ["Ann"], ["Ned"], 2.0, "https://www.storytel.com/c.jpg", "en"),
        ("overdrive", "overdrive-9", None, "Dune", ["Ann"], ["Ned"], 600.0, "wide", "en"),
        ("openlibrary", "openlibrary-works-OL1W", None, "Cube Route", ["Ann"], [], None, "https://covers.openlibrary.org/b/id/3-L.jpg", "en"),
    ]
    assert registry.get("apple").name == "apple" and registry.get("x") is None


def test_library_pages(spark):
    """Audiobooks of this library only, the first five of each query."""
    rows = [("l", 1, i, [("ebook-overdrive",), ("audiobook-overdrive",)] if i % 2 else [("ebook-overdrive",)]) for i in range(14)] + [("other", 1, 1, [("audiobook-overdrive",)]), ("l", 2, 3, None), ("l", 2, 4, [])]
    df = spark.createDataFrame(rows, "library string, query_id long, item_pos int, formats array<struct<id:string>>")
    assert sorted((r.query_id, r.item_pos) for r in library_page(df, "l").collect()) == [(1, i) for i in (1, 3, 5, 7, 9)]


def test_dispatch_of_odd_ids(spark):
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(["hardcover-book-1", "hardcover-edition-1", "hardcover-book-2", "hardcover-book-1", "storytel-s-7", "apple-audiobook-3", "B000000001", "x", "", None])], "n int, id string")
    kind = "native string, kind string, title string"
    books = {"hardcover": spark.createDataFrame([("1", "book", "Book"), ("1", "edition", "Edition"), ("1", "book", "Again")], kind), "storytel": spark.createDataFrame([("s-7", None, "Any kind")], kind)}
    got = {r.n: (r.state, r.title) for r in dispatch(ids, "id", books).collect()}
    assert got == {0: ("found", "Again"), 1: ("found", "Edition"), 2: ("not found", None), 3: ("found", "Again"), 4: ("found", "Any kind"), 5: ("no source", None), 6: ("no id", None), 7: ("no id", None), 8: ("no id", None), 9: ("no id", None)}
