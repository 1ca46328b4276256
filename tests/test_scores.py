"""Scores of every record for every other, whatever their brand and type."""

from difflib import SequenceMatcher

from folioforge.plans import catalogue, scoring_queries

from .compare import DATA, assert_equal, database

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_no_pair_above_the_floor_is_left_out(spark):
    part = database().execute("SELECT p_partkey, p_name, p_size FROM part").fetchall()
    names = {name for _, name, _ in part}
    sim = {(q, c): SequenceMatcher(None, q, c, autojunk=False).ratio() for q in names for c in names}
    want = {}
    for k, q, size in part:
        for have, c, other in part:
            delta = abs(size - other) / other
            bonus = 0.15 if delta <= 0.05 else -0.3 if delta > 0.25 else 0.0
            x = max(0.0, min(1.0, 0.55 * sim[q, c] + 0.3 + bonus if k % 2 else sim[q, c] + bonus))
            if x >= 0.8 * 0.55 + 0.7 * 0.3:
                want[k, have] = (round(x, 9), round(delta, 9))
    got = QUERIES["s4_score"](spark, str(DATA)).collect()
    assert len(got) == len(want) > 5 * len(part)
    assert all(abs(a - b) < 1e-8 for r in got for a, b in zip((r.confidence, r.delta), want[r.want, r.have], strict=True))


def test_scores_of_records_without_brand_type_or_size(spark, tmp_path):
    rows = [(1, "old ring", "a", "x", 10), (2, "old ring", "b", "y", 10), (3, "old ring", None, "x", 12), (4, "old rings", "a", None, None), (5, "old ring", None, None, None), (6, None, "a", "x", 10), (7, "tin cup", "a", "x", 10)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/rows")
    database(tmp_path).execute(f"COPY (FROM '{tmp_path}/rows/*.parquet') TO '{tmp_path}/part.parquet'")
    got = {(r.want, r.have) for r in QUERIES["s4_score"](spark, str(tmp_path)).collect()}
    assert {(1, 2), (2, 3), (4, 5), (5, 1)} <= got
    assert_equal(spark, QUERIES["s4_score"], SQL["s4_score"], tmp_path)


def test_each_pair_of_names_is_compared_once(spark, monkeypatch):
    seen, real = [], scoring_queries.with_title_similarity

    def step(df, *args, **options):
        seen.append(df.count())
        return real(df, *args, **options)

    monkeypatch.setattr(scoring_queries, "with_title_similarity", step)
    part = spark.read.parquet(f"{DATA}/part.parquet")
    many = part.selectExpr("explode(sequence(0, 4)) AS i", "*").selectExpr("p_partkey * 5 + i AS p_partkey", "p_name", "p_brand", "p_type", "p_size")
    assert scoring_queries._confident(many, many).count() > 25 * part.count()
    assert seen == [part.select("p_name").distinct().count() ** 2]


def test_records_of_one_kind_meet_in_several_tasks(spark):
    part = spark.range(400).selectExpr("id AS p_partkey", "'old ring' AS p_name", "cast(7 AS int) AS p_size")
    pairs = scoring_queries._confident(part, part)
    assert pairs.count() == 400 * 400
    tasks = pairs.selectExpr("spark_partition_id() AS task").groupBy("task").count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 400 * 400 / 2


def test_records_meet_as_lists_of_bounded_size(spark):
    part = spark.range(5000).selectExpr("id AS p_partkey", "if(id < 4999, 'old ring', 'tin cup') AS p_name", "cast(7 AS int) AS p_size")
    pairs = scoring_queries._confident(part, part)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(haves") < plan.index("Generate explode(wants") < plan.index("Join Inner")
    want = part.selectExpr("p_partkey AS want", "p_name AS asked")
    kinds = want.groupBy("asked").count().selectExpr("length(asked) AS asked_id", "asked", "count AS n")
    lists = [r.wants for r in scoring_queries._lists(want, kinds, "asked", "want").collect()]
    assert sorted(k for x in lists for k in x) == list(range(5000))
    assert max(map(len, lists)) < 3 * scoring_queries.MET and len(lists) <= 5000 / scoring_queries.MET + 2
    assert pairs.count() == 4999**2 + 1


def test_records_without_a_key_and_repeated_records_stay(spark, tmp_path):
    rows = [(None, "old ring", 10), (None, "old ring", 10), (3, "old ring", 10), (3, "old ring", 10), (None, "old rings", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/rows")
    database(tmp_path).execute(f"COPY (FROM '{tmp_path}/rows/*.parquet') TO '{tmp_path}/part.parquet'")
    assert_equal(spark, QUERIES["s4_score"], SQL["s4_score"], tmp_path)
