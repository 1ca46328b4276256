"""Queries over whole tables, against DuckDB or brute force on the fixture."""

from difflib import SequenceMatcher

from folioforge.plans import catalogue

from .compare import DATA, assert_equal, database

QUERIES = catalogue.queries()


def test_editions_of_all_orders(spark):
    assert_equal(spark, QUERIES["a6_edition_parent"], "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")


def test_sorted_scan_gives_every_key_its_place(spark):
    query = QUERIES["a27_sorted_scan"]
    assert_equal(spark, query, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
    places = [r.place for r in query(spark, str(DATA)).collect()]
    assert places == sorted(places) and len(places) > 1000


def test_fallback_of_all_titles(spark):
    assert_equal(spark, QUERIES["a2_search_fallback"], """
    WITH want AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_name || ' (unabridged)' ELSE p_name END AS p_name, min(p_type) AS p_type FROM part GROUP BY 1),
    hit AS (SELECT w.p_name, 'title' AS how, p.p_partkey, p.p_retailprice FROM want w JOIN part p USING (p_name)),
    wide AS (SELECT w.p_name, 'keywords', p.p_partkey, p.p_retailprice FROM want w JOIN part p USING (p_type) WHERE w.p_name NOT IN (SELECT p_name FROM part))
    SELECT p_name, how, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS pos FROM (SELECT * FROM hit UNION ALL SELECT * FROM wide) QUALIFY pos <= 5""")


def test_scores_of_all_records(spark):
    part = database().execute("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part").fetchall()
    want = {}
    for k, q, brand, kind, size in part:
        for have, c, b, t, other in part:
            if (brand, kind) != (b, t):
                continue
            delta = abs(size - other) / other
            bonus = 0.15 if delta <= 0.05 else -0.3 if delta > 0.25 else 0.0
            sim = SequenceMatcher(None, q, c, autojunk=False).ratio()
            x = max(0.0, min(1.0, 0.55 * sim + 0.3 + bonus if k % 2 else sim + bonus))
            if x >= 0.8 * 0.55 + 0.7 * 0.3:
                want[k, have] = (round(x, 9), round(delta, 9))
    got = {(r.want, r.have): (r.confidence, r.delta) for r in QUERIES["s4_score"](spark, str(DATA)).collect()}
    assert got.keys() == want.keys() and {k for k, _ in got} == {p[0] for p in part}
    assert all(abs(a - b) < 1e-8 for x in got for a, b in zip(got[x], want[x], strict=True))


def test_covers_of_all_titles(spark):
    assert_equal(spark, QUERIES["c6_cover"], "SELECT p_name AS record, concat('c', min(p_partkey)) AS cover FROM part GROUP BY p_name")


def test_search_takes_all_requests(spark):
    small = {k for (k,) in database().execute("SELECT p_partkey FROM part WHERE p_size <= 40").fetchall()}
    found = {r.query_id for r in QUERIES["c1_search"](spark, str(DATA)).select("query_id").distinct().collect()}
    assert found & small


def test_queries_that_were_samples_keep_their_names(spark):
    for name in ("a6_edition_parent", "a27_sorted_scan", "s4_score", "a2_search_fallback", "c6_cover"):
        assert {name, f"{name}_whole"} <= set(QUERIES)
