"""Series, authors and provider records: worked examples, odd rows, and the author search against brute force."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import authors, enrich, graph, handler, series, store
from folioforge.plans import catalogue
from folioforge.sources import records

from .compare import DATA, database


def test_position_of_a_work(spark):
    kind = "w long, links array<struct<work:long,text:string,number:double>>"
    rows = [(1, [(2, "9", None), (1, " 3 ", 7.0)]), (1, [(1, "0", 2.0)]), (1, [(1, "", 1.5)]), (1, [(5, "4", None)]), (1, [(5, "4", None), (6, "5", None)]), (1, []), (1, None), (1, [(1, None, 0.0)])]
    df = spark.createDataFrame(rows, kind)
    assert [r[0] for r in df.select(series.position_of(F.col("links"), F.col("w"))).collect()] == ["3", "2", "1.5", "4", None, None, None, None]


def test_series_of_a_work(spark):
    """Placed before larger, an order only where nothing else is left, none from a work that can't be trusted."""
    hits = spark.createDataFrame([(1, "Dune", 0, 10, ["Dune"]), (2, "Dune", 0, 11, ["Emma"]), (2, "Dune", 1, None, ["Dune"]), (2, "Dune", 2, 12, ["Dun"]), (2, "Dune", 3, 13, ["Dune"]), (3, "Emma", 0, 14, [None, "", "Emma, Book 2"]), (4, None, 0, 10, ["Dune"])], "query long, title string, pos int, work long, forms array<string>")
    place = lambda w, t: [(w, t, None)]
    rows = [(10, "Saga", 1, place(10, "1"), 0), (10, "World", 2, place(10, "0"), 1), (10, "Dune Universe", 3, place(10, "7"), 2), (10, "Omnibus Edition", 4, place(10, "1"), 3), (14, "Box-Set", 5, place(14, None), 0), (14, "", 6, None, 1)]
    found = spark.createDataFrame(rows, "work long, name string, series long, links array<struct<work:long,text:string,number:double>>, pos int")
    sizes = spark.createDataFrame([(1, 6), (2, 90), (3, 99)], "series long, members long")
    assert {r.query: (r.work, r.primary, r.secondary) for r in series.resolved(hits, found, sizes).collect()} == {1: (10, ("Saga", "1"), ("World", None)), 3: (14, ("Box-Set", None), None)}
    assert series.resolved(hits.limit(0), found, sizes).count() == 0


def test_author_info(spark):
    rows = spark.createDataFrame([("Ann B", "ann b", None, "short", 0), ("Ann B", "Ann B", "x", "a *longer* life", 1), ("Ann B", "Ann C", "y", "by far the longest life of all", 2), ("Bob", "Rob", "", "one", 0), ("Bob", "Roy", "z", "two", 1), ("Bob", None, None, " ", 2)], "name string, row_name string, image string, bio string, pos int")
    assert {tuple(r) for r in authors.info_of_rows(rows).collect()} == {("Ann B", "x", "a longer life"), ("Bob", "z", "one")}
    hits = spark.createDataFrame([("Ann Bee", i, a) for i, a in enumerate([9, None, 1, 2, 3, 4])] + [("Zed", 0, 9)], "name string, pos int, author long")
    known = spark.createDataFrame([(9, "Cy Dee", "c", "c"), (1, "Ann Bee", "http://x/nophoto/1", "N/A"), (2, "Anne Bee", "p", " bio "), (3, "Ann Bee", "q", "r"), (4, "Ann Bee", "late", "late")], "author long, author_name string, image string, bio string")
    assert {tuple(r) for r in authors.info_of_hits(hits, known).collect()} == {("Ann Bee", "p", "bio")}


def test_author_pages(spark):
    page = '<h1 class="bc-heading bc-color-base bc-size-extra-large bc-text-secondary bc-text-bold"> Ann  Bee </h1><div class="bc-expander-content"><span>A life &lt;of&gt; words.</span></div><img src="u.__01_SX120_CR0,0,120,120__.jpg" class="author-image-outline">' + "".join(f'<a class="bc-link bc-color-link" href="/author/{n}/B00000000{i}?r=1"><h3>{n}</h3></a>' for i, n in enumerate(["cy", "Él", "ed", "Bo", "ab"]))
    rows = [("a", 200, page), ("b", 404, page), ("c", 200, '<button class="q">Play Sample</button>'), ("d", 200, "<p>nothing</p>"), ("e", None, None)]
    got = {r.asin: r for r in authors.author_pages(spark.createDataFrame(rows, "asin string, status int, html string")).collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "ok", "b": "NOT_FOUND", "c": "book", "d": "REGION_UNAVAILABLE", "e": "REGION_UNAVAILABLE"}
    a = got["a"]
    assert (a.name, a.description, a.image) == ("Ann Bee", "A life <of> words.", "u.jpg")
    assert [(x.name, x.asin) for x in a.similar] == [("ab", "B000000004"), ("Bo", "B000000003"), ("cy", "B000000000"), ("ed", "B000000002"), ("Él", "B000000001")]


def test_author_search_against_brute_force(spark):
    """The registered search, author by author."""
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    clean = lambda x: "".join(ch for ch in x.lower() if ch.isalnum() or ch == " ").strip()
    part = lambda x, i: clean(x.split()[i])
    same = lambda a, b: ratio(clean(a), clean(b)) >= 0.9 or (ratio(part(a, 0), part(b, 0)) >= 0.85 and ratio(part(a, -1), part(b, -1)) >= 0.85)
    con = database()
    people = {}
    for k, nation in con.execute("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY 1").fetchall():
        first, last = ("Ann", "Bob", "Cleo", "Dora")[k % 4], nation[0] + nation[1:].lower()
        people[k] = (first, last, f"{first}{' Q. ' if k % 3 == 0 else ' '}{last}")
    asin = lambda k: f"B{k:09d}"
    words = lambda x: {w for w in "".join(ch if ch.isalnum() else " " for ch in x.lower()).split()}
    want = set()
    products = {}
    for o, k in con.execute("SELECT l_orderkey, l_suppkey FROM lineitem").fetchall():
        products.setdefault((f"{people[k][0]} {people[k][1]}", o), []).append((asin(k), people[k][2]))
    for q in {f"{a} {b}" for a, b, _ in people.values()}:
        hits = sorted((-len(words(q) & words(n)), asin(k), n, k) for k, (_, _, n) in people.items() if k % 2 == 0 and words(q) & words(n))[:25]
        close, seen = [], set()
        for pos, (_, a, n, k) in enumerate(hits, 1):
            if same(q, n) and n.lower() not in seen:
                seen.add(n.lower())
                close.append((n, pos, a, 2 * (k % 5 == 0) + (k % 7 == 0)))
        groups = {}
        for x in close:
            w = x[0].lower().split()
            groups.setdefault((w[0], w[-1]), []).append(x)
        for g in groups.values():
            marks = {w.strip(".") for x in g for w in x[0].lower().split()[1:-1]}
            for n, pos, a, _ in g if len(marks) > 1 else [max(g, key=lambda x: (x[3], -x[1]))]:
                want.add((q, a, n, pos, "known"))
        if close:
            continue
        count, first = {}, {}
        for (query, o), made in sorted(products.items()):
            if query == q:
                for i, (a, n) in enumerate(sorted(made)):
                    if ratio(clean(q), clean(n)) >= 0.7:
                        count.setdefault((a, n), set()).add(o)
                        first.setdefault((a, n), (o, i))
        named = {}
        for key, orders in count.items():
            named.setdefault(key[1].lower(), []).append((-len(orders), first[key], *key))
        for pos, (fewer, _, a, n) in enumerate(sorted((min(v)[0], min(x[1] for x in v), *min(v)[2:]) for v in named.values()), 1):
            want.add((q, a, n, pos, "catalogue"))
    got = {tuple(r) for r in catalogue.queries()["c7_author_search"](spark, str(DATA)).select("query", "asin", "name", "pos", "how").collect()}
    assert got == want and {x[4] for x in got} == {"known", "catalogue"}


def test_records_of_odd_documents(spark):
    """Missing parts give nulls and empty lists, documents without a title no record."""
    names = "array<struct<name:string>>"
    book = f"book struct<consumableId:string,name:string,authors:{names},series:{names},seriesOrder:double,largeCover:string,language:struct<isoValue:string>>, abook struct<narrators:{names},description:string,publisher:string,releaseDate:string>"
    out = records.storytel(spark.createDataFrame([(("1", "T", None, None, None, None, None), None), (("2", "", None, None, None, None, None), None), (None, None)], book)).collect()
    assert len(out) == 1 and (out[0].title, out[0].authors, out[0].narrators, out[0].image, out[0].series_primary) == ("T", [], [], None, None)
    works = spark.createDataFrame([("/works/OL1W", "cube route", "bare text", [(("/a/1",),), ((None,),), (("/a/9",),)], None), ("/works/OL2W", None, None, None, None)], "key string, title string, description string, authors array<struct<author:struct<key:string>>>, covers array<long>")
    out = records.openlibrary(works, spark.createDataFrame([("/a/1", "Ann"), ("/a/9", "")], "key string, name string")).collect()
    assert [(r.id, r.title, r.authors, r.summary, r.image) for r in out] == [("openlibrary-works-OL1W", "Cube Route", ["Ann"], "bare text", None)]


def test_upserts_keep_the_first_time_and_gate(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    old = spark.createDataFrame([(1, ["g"]), (2, ["g"]), (3, ["g"])], "k int, genres array<string>").withColumns({"created_at": at("2020-01-01"), "updated_at": at("2021-01-01")})
    new = spark.createDataFrame([(1, ["g"]), (2, ["h"]), (3, []), (4, [])], "k int, genres array<string>")
    got = {r.k: (r.action, r.genres, r.created_at.year, r.updated_at.year) for r in store.upsert_records(old, new, ["k"], ["genres"], store.GATES["book"], at("2024-01-01")).collect()}
    assert got == {1: ("noop", ["g"], 2020, 2021), 2: ("update", ["h"], 2020, 2024), 3: ("keep", ["g"], 2020, 2021), 4: ("insert", [], 2024, 2024)}
    rows = store.projected(spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":null,"b":"x"}',), ("{bad",)], "json string"), "a INT NOT NULL, b STRING").collect()
    assert [tuple(r) for r in rows] == [(1, "x")]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain + star + [(7, 7)], "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}}


def test_texts(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(T.html_text(F.lit("<p>A &amp; b</p><p>c<br>d  e</p><script>x</script>"))) == "A & b\n\nc\nd e"
    assert f(T.clean_biography(F.lit("A *b* ([Source][1]).\r\n\r\n\r\nc\n  [1]: http://x"))) == "A b.\n\nc"
    assert [f(T.number_text(F.lit(x).cast("double"))) for x in (1, 1.5, None)] == ["1", "1.5", None]
    assert f(enrich.chapter_mismatch(F.lit(None).cast("string"))) == "unknown" and f(enrich.document_kind(F.lit("{bad"))) is None


def test_series_chain(spark):
    """What can't be found, trusted or placed is null; a series only in editions stays where there is no other."""
    works = spark.createDataFrame([(1, "Red Moon"), (2, "Blue Sun"), (3, "Lone Star")], "work long, title string")
    links = spark.createDataFrame([(10, 1, "2", None, 1), (11, 1, None, 3.0, 0), (12, 1, "", None, 2), (13, 2, None, None, 0)], "series long, work long, text string, number double, pos int")
    names = spark.createDataFrame([(10, "Moons"), (11, "Moons (Publication Order)"), (12, "Skies"), (13, "Suns Omnibus"), (99, "Other")], "series long, name string")
    members = spark.createDataFrame([(10, 1), (10, 5), (10, 5), (12, 1), (12, 6), (12, 7), (13, 2), (99, 1)], "series long, work long")
    wanted = spark.createDataFrame([("red moons",), ("blue sun",), ("lone star",), ("red herring",), ("nothing",)], "query string")
    got = {r["query"]: (r.work, r.primary and tuple(r.primary), r.secondary and tuple(r.secondary)) for r in series.chain(wanted, works, links, names, members).collect()}
    assert got == {"red moons": (1, ("Moons", "2"), ("Skies", None)), "blue sun": (2, ("Suns Omnibus", None), None), "lone star": (3, None, None), "red herring": (None, None, None), "nothing": (None, None, None)}


def test_snapshots_are_pruned_by_the_keys_still_wanted(spark, tmp_path):
    spark.range(200_000).selectExpr("id % 5000 AS work", "id AS series").write.parquet(f"{tmp_path}/links")
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        links = spark.read.parquet(f"{tmp_path}/links")
        found = links.join(series.still_wanted(spark.range(7).withColumnRenamed("id", "work"), "work"), "work", "left_semi")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" in plan and found.count() == 7 * 40
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_answers_to_requests(spark):
    day = lambda n: f"2024-01-{n:02d}"
    times = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp"))
    asked = spark.createDataFrame([(k, u) for k, u in [(1, False), (2, True), (3, False), (4, True), (5, True), (6, True), (7, False), (8, False), (9, False), (9, True), (10, False)]], "key long, update boolean")
    cache = times(spark.createDataFrame([(1, "c1", day(20)), (2, "c2", day(20)), (3, "c3", day(5)), (8, None, day(20)), (10, "c10", day(9))], "key long, value string, expires_at string"), "expires_at")
    stored = times(spark.createDataFrame([(2, "s2", day(9)), (3, "s3", day(1)), (4, "s4", day(1)), (5, "s5", day(1)), (6, "s6", None), (9, "s9", day(1))], "key long, value string, updated_at string"), "updated_at")
    fetched = spark.createDataFrame([(4, "f4", None), (5, None, "PRODUCT_DELISTED"), (6, None, "SERVER"), (7, "f7", None), (9, "f9", None), (10, None, "REGION_UNAVAILABLE")], "key long, value string, code string")
    got = {r.key: (r.how, r.value, r.code, r.cached, r.cached_until and r.cached_until.day) for r in handler.answered(asked, cache, stored, fetched, F.lit(day(10)).cast("timestamp")).collect()}
    assert got == {
        1: ("cache", "c1", None, "c1", 20), 2: ("recent", "s2", None, "c2", 20), 3: ("store", "s3", None, "s3", 15), 4: ("updated", "f4", None, "f4", 15), 5: ("kept", "s5", None, None, None), 6: ("failed", None, "SERVER", None, None),
        7: ("created", "f7", None, "f7", 15), 8: ("failed", None, "NOT_FOUND", None, None), 9: ("updated", "f9", None, "f9", 15), 10: ("failed", None, "REGION_UNAVAILABLE", None, None),
    }


def test_what_makes_a_page_a_books(spark):
    from folioforge.operators.authors import is_book_page
    from folioforge.plans.more_queries import _PROBES

    books = {_PROBES[i] for i in (0, 1, 2, 6, 10, 12, 16, 18)}
    nested = '<h1 class=bc-heading>\n<span><b title="x" class="a bc-text-bold">T</b></span></h1>'
    more = {nested: True, "<button>" + "<i>x</i> " * 100_000: False, "<button>" + "<i>x</i> " * 100_000 + "Sample": True, "<p>a</p>" * 200_000: False, "<buttons>Sample</buttons>": False, "<div class='bc-button-text'><i>Sam</i>ple</div>": True, "<style>.product-listener{}</style>": False}
    pages = [(h, h in books) for h in _PROBES] + list(more.items()) + [(None, False)]
    for r in spark.createDataFrame(pages, "html string, want boolean").withColumn("got", is_book_page(F.col("html"))).collect():
        assert r.got == r.want, (r.html or "")[:80]
