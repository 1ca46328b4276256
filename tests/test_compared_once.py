"""Equal texts are compared once, however many rows have them."""

from pyspark.sql import functions as F

from folioforge.operators import enrich
from folioforge.plans import scoring_queries, text_queries

from .compare import DATA


def _counting(monkeypatch, module, name):
    """Rows that the module's function is given, call by call."""
    seen, real = [], getattr(module, name)

    def step(df, *args, **options):
        seen.append(df.count())
        return real(df, *args, **options)

    monkeypatch.setattr(module, name, step)
    return seen


def test_cover_of_many_equal_hits_compares_one(spark, monkeypatch):
    seen = _counting(monkeypatch, enrich, "with_title_similarity")
    rows = [("r", "Dune", "Ann", "Dune", "Ann", None if k == 3 else f"c{k}", k) for k in range(3, 500)] + [("r", "Dune", "Ann", "Dune 2", "Ann", "first", 0), ("s", "Emma", None, "Emma", "Bob", "e", 9), ("s", "Emma", None, "Emma", "Bob", "d", 8)]
    hits = spark.createDataFrame(rows, "record string, title string, author string, hit_title string, hit_author string, cover string, pos long")
    assert {tuple(r) for r in enrich.square_cover(hits).collect()} == {("r", None), ("s", "d")}
    assert seen == [3]


def test_scores_compare_pairs_of_names(spark, monkeypatch):
    seen = _counting(monkeypatch, scoring_queries, "with_title_similarity")
    part = spark.read.parquet(f"{DATA}/part.parquet")
    many = part.selectExpr("explode(sequence(0, 4)) AS i", "*").selectExpr("p_partkey * 5 + i AS p_partkey", "p_name", "p_brand", "p_type", "p_size")
    assert scoring_queries._confident(many, many).count() > 5 * part.count()
    met = part.alias("a").join(part.alias("b"), ["p_brand", "p_type"]).selectExpr("a.p_name AS q", "b.p_name AS c").distinct().count()
    assert seen == [met]


def test_equal_titles_are_normalised_once(spark, monkeypatch, tmp_path):
    taken, real = spark.sparkContext.accumulator(0), text_queries.T.normalize_title

    def count(x):
        taken.add(1)
        return x

    monkeypatch.setattr(text_queries.T, "normalize_title", lambda c: real(F.udf(count, "string")(c)))
    rows = 2000
    part = spark.range(rows).selectExpr("id AS p_partkey", "concat('old ring ', id % 2) AS p_name", "cast(id % 5 AS int) AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = text_queries.n1_normalize_title(spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 6 * rows
    assert taken.value <= 6 * 10
