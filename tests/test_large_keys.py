"""Queries against their SQL where keys are as large as in tables sixty times sf0.1."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

from .compare import DATA, assert_equal


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """sf0.001 with items of one order whose part keys lie on both sides of 1,000,000; no two places are equal."""
    folder = tmp_path_factory.mktemp("large")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{DATA}/orders.parquet') TO '{folder}/orders.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_partkey * 7001 AS l_partkey) FROM '{DATA}/lineitem.parquet') TO '{folder}/lineitem.parquet'")
    return folder


@pytest.mark.parametrize("name", ["g13_distinct_last", "p7_book_records", "w15_first_match", "x3_series_pick"])
def test_places_of_items_with_large_keys(spark, large, name):
    assert_equal(spark, queries()[name], oracle_sql()[name], large)
