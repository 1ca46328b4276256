import pytest

import __spark_entry__
from folioforge.plans import catalogue

from .compare import DATA, assert_equal

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_takes_the_right_edition(spark):
    """A pinned id first, junk demoted, a box set below the single book."""
    from folioforge.operators.search import search

    requests = spark.createDataFrame([(1, "01 - Dune, Book 1", "Frank Herbert", None, "B000000001", None, 600_000, "us"), (2, "Dune", "Frank Herbert", None, None, None, None, "us")], "query_id long, title string, author string, track string, asin string, narrator string, duration_ms long, region string")
    rows = [("a", "B000000001", "Dune", ["Frank Herbert"], ["N"], 600.0), ("b", None, "Dune Box Set", ["Frank Herbert"], [], None), ("c", "B000000002", "Dune", ["Frank Herbert"], ["Virtual Voice"], 900.0), ("d", None, "Other", ["Someone"], [], None)]
    source = spark.createDataFrame([(q, "audible", i, *r, None, "english") for q in (1, 2) for i, r in enumerate(rows)], "query_id long, provider string, item_pos int, id string, asin string, title string, authors array<string>, narrators array<string>, audio_seconds double, cover string, language string")
    out = search(requests, [source]).orderBy("query_id", "position").collect()
    assert [(r.id, round(r.confidence, 6)) for r in out if r.query_id == 1][0] == ("a", 1.0)
    assert "d" not in {r.id for r in out} and [r.id for r in out if r.query_id == 2][0] == "a"
