"""Very long texts and empty tables through every operator."""

import hashlib
import random
import zlib

import pytest

from folioforge.llm import decontaminate, html_extract, media, metric_join, ngram_join, packing, pii, ranked_search, resample, substring_dedup, token_counts, tokens, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = 120_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    return " ".join(f"w{rng.randrange(40_000)}" for _ in range(WORDS)) + " mail a.b@c.de"


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, long_text), (2, long_text + " end"), (3, "a short one")]], DOCS).repartition(2).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(docs, none, tmp_path):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.kept(substring_dedup.dedup(docs, f"file://{tmp_path}/a")).collect()}
    assert got == {1: (WORDS + 2, 0), 2: (WORDS + 3, WORDS + 2), 3: (3, 0)}
    assert substring_dedup.kept(substring_dedup.dedup(none, f"file://{tmp_path}/b")).count() == 0


def test_ngram_join(docs, none, tmp_path):
    found, _ = ngram_join.join(docs, f"file://{tmp_path}/a")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got[1][1] == got[2][1] == 1 and got[2][0] == got[1][0] + 1 and got[3] == (1, 3)
    assert ngram_join.join(none, f"file://{tmp_path}/b")[0].count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3] and all(0 <= r.score <= 1 for r in rows)
    model = toxicity.learn(none, labels.limit(0))
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(none, model).count() == 0


def test_decontamination(spark, docs, none, long_text):
    tail = " ".join(long_text.split()[-40:])
    items = spark.createDataFrame([(7, tail)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.judged(decontaminate.contamination(docs, items)).collect()}
    # The last forty words, of which the address is four more.
    assert got[1] == got[2] == (43, False) and got[3] == (0, False)
    assert decontaminate.contamination(none, items).count() == 0


def test_packing(docs, none, tmp_path, long_text):
    ids = tokens.Pieces().encode(long_text)
    rows = packing.pack(packing.pieces(docs), f"file://{tmp_path}/a").filter("doc_id = 1").orderBy("piece").collect()
    assert sum(r.length for r in rows) == len(ids) + 1 and [r.start for r in rows] == list(range(0, len(ids) + 1, 4096))
    assert packing.pack(packing.pieces(none), f"file://{tmp_path}/b").count() == 0


def test_media(docs, none, long_text):
    got = {r.doc_id: r for r in media.features(media.store(docs)).collect()}
    body = media.pad(long_text.encode())
    assert (got[1].n_bytes, got[1].payload_sha256, got[1].tail_crc32) == (len(long_text), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
    assert media.features(media.store(none)).count() == 0


def test_pii(docs, none, long_text):
    got = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    assert got[1] == got[2] == f"email:{len(long_text) - 8}:{len(long_text)}" and got[3] == ""
    assert pii.find_spans(none).count() == 0


def test_token_counts(docs, none, long_text):
    document, _ = token_counts.laid_out("s", "en", long_text)
    assert token_counts.counts(docs).filter("doc_id = 1").agg({"n_tokens": "sum"}).first()[0] == len(tokens.spans(document))
    assert token_counts.counts(none).count() == 0


def test_html(spark):
    body = "".join(f"<p>Paragraph number {i} says something of its own, at some length, as articles do.</p>" for i in range(8000))
    kind = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, "u", f"<html><body><nav><a href=x>Menu</a></nav><article>{body}</article></body></html>"), (2, None, None)], kind)
    got = {r.page_id: r for r in html_extract.extract(pages, html_extract.learn(pages)).collect()}
    assert got[1].text.count("\n\n") == 7999 and got[1].text.endswith("number 7999 says something of its own, at some length, as articles do.") and "Menu" not in got[1].text and got[2].n_chars == 0
    nothing = spark.createDataFrame([], kind)
    assert (html_extract.learn(nothing) == html_extract.PRIOR).all() and html_extract.extract(nothing).count() == 0


def test_url_filters(spark, tmp_path):
    kind = "page_id long, url string, html string"
    path = "/" + "x" * 1_000_000
    rows = [(1, f"http://a.NET{path}", "<a href='http://b.com/'>" * 20_000), (2, f"http://b.com{path}?q", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, kind), url_filters.rule_table(spark), f"file://{tmp_path}/a").collect()}
    assert got[1] == ("a.net", path, "net/", "block") and got[2][:3] == ("b.com", path, None)
    none = spark.createDataFrame([], kind)
    assert url_filters.judge(none, url_filters.rule_table(spark), f"file://{tmp_path}/b").count() == 0
    assert {r.verdict for r in url_filters.judge(spark.createDataFrame(rows, kind), url_filters.rule_table(spark).limit(0), f"file://{tmp_path}/c").collect()} == {"allow"}


def test_embeddings(spark, tmp_path):
    rng = random.Random(2)
    wide = [rng.gauss(0, 1) for _ in range(20_000)]
    rows = [(1, wide), (2, [2 * x for x in wide]), (3, [-x for x in wide]), (4, wide[:-1])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), f"file://{tmp_path}/a").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_resampling_and_search(spark, docs, long_text, tmp_path):
    target = spark.createDataFrame([(0, "w1 w2 short")], "item_id long, text string")
    got = {r.doc_id: r for r in resample.resample(docs, target, f"file://{tmp_path}/a").collect()}
    assert got[1].n_features == WORDS + 5 and got[2].n_features == WORDS + 6
    found = ranked_search.search(docs, target, f"file://{tmp_path}/b").collect()
    want = ranked_search.brute([(1, long_text), (2, long_text + " end"), (3, "a short one")], [(0, "w1 w2 short")])
    assert sorted(map(tuple, found)) == sorted(want)
