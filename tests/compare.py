"""A query's rows against its DuckDB twin's."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def database(data: Path = DATA):
    con = duckdb.connect()
    for path in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in values)


def assert_equal(spark, query, sql, data: Path = DATA):
    df = query(spark, str(data))
    got = rows(df.columns, df.collect())
    cursor = database(data).execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
