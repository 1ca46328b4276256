"""Registered queries against SQL, and the pipeline stage by stage against brute force."""

import pytest

from folioforge.llm import decontaminate, ngram_join, pii, registry, tokens, toxicity
from folioforge.llm.tables import table

from ..compare import DATA, assert_equal

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name,of", [("op2_toxicity", "documents"), ("op4_url_filters", "pages"), ("op5_best_fit_packing", "documents"), ("op6_media_columns", "documents"), ("op7_pii", "documents"), ("op8_html_extraction", "pages"), ("op9_token_counts", "documents")])
def test_query_covers_its_table(spark, name, of):
    key = {"documents": "doc_id", "pages": "page_id"}[of]
    assert QUERIES[name](spark, str(DATA)).select(key).distinct().count() == table(spark, str(DATA), of).select(key).distinct().count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    docs = table(spark, str(DATA), "documents")
    columns, after = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after.append(docs)
        assert name == "packing" or docs.columns == columns
    before = [table(spark, str(DATA), "documents"), *after]
    texts = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in before[:5]]
    scores = toxicity.score(before[0], toxicity.learn(before[0], table(spark, str(DATA), "labels"))).collect()
    assert sorted(x[0] for x in texts[1]) == sorted(r.doc_id for r in scores if r.score < 0.5)
    linked = ngram_join.brute(texts[1], corpus_pipeline.NEAR)
    assert sorted(x[0] for x in texts[2]) == sorted(i for i, (_, c) in linked.items() if c == i)
    items = [(r.item_id, r.text) for r in table(spark, str(DATA), "benchmark").collect()]
    assert sorted(x[0] for x in texts[3]) == sorted(i for i, v in decontaminate.brute(texts[2], items).items() if not v[4])
    finder = pii.Finder()
    assert dict(texts[4]) == {i: pii.masked(t, finder.find(t)) for i, t in texts[3]}
    t = tokens.Pieces()
    lengths = {i: len(t.encode(x)) + 1 for i, x in texts[4]}
    packed = {r.doc_id: r.n for r in after[4].groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert packed == lengths
    total = after[4].agg({"length": "sum"}).first()[0]
    assert after[4].select("sequence_id").distinct().count() <= -(-total // 4096) + 1
    assert corpus_pipeline.run(spark, str(DATA)).count() == after[4].count()


def test_pipeline_of_odd_rows_and_of_nothing(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names go through all stages; so does an empty table."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, node string, sig string, _gone string, _row_key string, key string, row_key string"
    rows = [(1, None), (2, ""), (None, "x y mail a.b@c.de"), (3, "word and " * 6000), (3, "word and " * 6000), (4, "one two three four five six seven"), (5, "one two three four five six seven"), (6, " \n "), (None, None)]
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", None, len(t or ""), *"abcdef") for i, t in rows], kind)
    spark.createDataFrame([(1, 0, None), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = [(1, 1), (2, 1), (3, 3), (3, 3), (4, 1), (6, 1), (None, 1), (None, 1)]
    assert sorted((r.doc_id or 0) for r in out) == sorted((i or 0) for i, n in kept for _ in range(n))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/odd/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
