"""Authors of whole catalogues, against plain Python."""

from collections import defaultdict
from difflib import SequenceMatcher
from pathlib import Path

from pyspark.sql import functions as F

from __spark_entry__ import queries
from folioforge.operators import authors

from .compare import database

#: Several suppliers of each nation, of whom the first twenty products show few.
DATA = Path("/root/testdata/sf0.01")


def test_authors_of_all_products(spark):
    con = database(DATA)
    people = con.execute("""
    SELECT q.n_name, l_orderkey, l_linenumber, l_partkey, s_suppkey, s.n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation p ON p.n_nationkey = c_nationkey
    JOIN nation q ON q.n_regionkey = p.n_regionkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey""").fetchall()
    plain = lambda x: x.lower().replace("_", "")
    near = {(q, n): SequenceMatcher(None, plain(q), plain(n), autojunk=False).ratio() >= 0.7 for q, n in {(q, n) for q, *_, n in people}}
    products, first = defaultdict(set), {}
    for q, order, line, part, asin, name in people:
        if near[q, name]:
            products[q, name, asin].add(order)
            first[q, name, asin] = min(first.get((q, name, asin), (order, line, part)), (order, line, part))
    best = {}
    for (q, name, asin), of in sorted(products.items()):
        place = (-len(of), first[q, name, asin], asin)
        best[q, name] = min(best.get((q, name), place), place)
    got = {(r.query, r.name): r.asin for r in queries()["w7_catalogue_authors"](spark, str(DATA)).collect()}
    assert got == {k: str(asin) for k, (*_, asin) in best.items()}
    assert max(len(of) for of in products.values()) > 20


def test_products_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def once(x):
        read.add(1)
        return x

    rows = [("us", k, k, [(f"B{k % 3}", "Ann Lee"), (f"C{k % 2}", "Bob Ray")]) for k in range(600)]
    products = spark.createDataFrame(rows, "region string, product long, pos long, authors array<struct<asin:string,name:string>>")
    products = products.withColumn("authors", F.udf(once, products.schema["authors"].dataType).asNondeterministic()("authors"))
    asked = spark.createDataFrame([(f"Ann Lee{'e' * k}", "us") for k in range(3)], "query string, region string")
    got = {tuple(r) for r in authors.catalogue_authors(products, asked, "region").collect()}
    assert got == {(f"Ann Lee{'e' * k}", "B0", "Ann Lee", 1) for k in range(3)}
    assert read.value == len(rows)


def test_authors_of_several_names_catalogues_and_rows(spark):
    """Products count once: in several rows or catalogues, by several names; empty names and catalogues are none."""
    rows = [
        ("us", 1, 5, [("A", "Ann Lee"), ("A", "Anne Lee"), ("B", "Bob Ray"), ("", "Ann Lee"), ("D", None)]), ("us", 1, 5, [("A", "Ann Lee")]), ("uk", 1, 4, [("A", "Ann Lee"), ("E", "Ann Lee")]),
        ("uk", 2, 6, [("A", "Zoe Zip"), ("E", "Ann Lee")]), ("us", 3, 2, [("A", "Anne Lee"), ("A", "Zoe Zip")]), ("us", 4, 8, [("A", "Ann Leeh")]), (None, 9, 0, [("E", "Ann Lee")]), ("uk", 7, 1, None), ("de", 8, 1, [("E", "Ann Lee")]),
    ]
    products = spark.createDataFrame(rows, "region string, product long, pos long, authors array<struct<asin:string,name:string>>")
    pairs = [("Ann Lee", "us"), ("Ann Lee", "uk"), ("Ann Lee", "uk"), ("Zoe Zap", "uk"), ("Bob Rey", "us"), ("Nil", "us")]
    asked = spark.createDataFrame(pairs, "query string, region string")
    people = [(w, p, (at, i), *a) for w, p, at, of in rows for i, a in enumerate(of or []) if a[0] and a[1]]
    want = set()
    for q in {q for q, _ in pairs}:
        near = [x for x in people if (q, x[0]) in pairs and SequenceMatcher(None, q.lower(), x[4].lower(), autojunk=False).ratio() >= 0.7]
        named = {}
        for asin in {x[3] for x in near}:
            of = [x for x in near if x[3] == asin]
            named.setdefault(max(of, key=lambda x: x[2])[4], []).append((-len({x[1] for x in of}), min(x[2] for x in of), asin))
        places = sorted((min(v)[0], min(x[1] for x in v), min(v)[2], name) for name, v in named.items())
        want |= {(q, asin, name, pos) for pos, (_, _, asin, name) in enumerate(places, 1)}
    assert {tuple(r) for r in authors.catalogue_authors(products, asked, "region").collect()} == want and len(want) > 3
    own = products.filter("region IS NOT NULL").withColumn("query", F.lit("Ann Lee")).drop("region")
    assert {tuple(r) for r in authors.catalogue_authors(own).collect()} == {("Ann Lee", "E", "Ann Lee", 1), ("Ann Lee", "A", "Ann Leeh", 2)}
