from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions.similarity import with_similarity, with_title_similarity
from folioforge.operators import records, scoring, store
from folioforge.operators.dedupe import CANDIDATE, dedupe_and_rank
from folioforge.operators.graph import key_components
from folioforge.streaming import breaker

DEFAULTS = dict(query_id=1, provider="hardcover", provider_pos=0, item_pos=0, id="x", asin=None, title="Dune", authors=["A"], narrators=[], audio_seconds=None, cover=None, language=None, confidence=0.85, delta=None, pinned=False, junk=False, bundle=False, language_conflict=False, narrator_match=False)


def ranked(spark, *rows):
    full = [{**DEFAULTS, "item_pos": i, "id": str(i), **r} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    return dedupe_and_rank(spark.createDataFrame([tuple(r[n] for n in names) for r in full], CANDIDATE)).orderBy("query_id", "position").collect()


def test_same_store_id_merges_and_richer_wins(spark):
    out = ranked(spark, {"asin": "B000000001", "confidence": 0.8}, {"asin": "b000000001", "confidence": 0.9, "cover": "c"})
    assert [(r.id, r.members) for r in out] == [("1", 2)]


def test_adjacent_minutes_stay_apart_and_same_minute_merges(spark):
    out = ranked(spark, {"audio_seconds": 600.0}, {"audio_seconds": 660.0}, {"audio_seconds": 610.0})
    assert sorted(r.members for r in out) == [1, 2]


def test_unknown_language_does_not_bridge(spark):
    out = ranked(spark, {"audio_seconds": 600.0, "language": "en"}, {"audio_seconds": 600.0}, {"audio_seconds": 600.0, "language": "de"})
    assert sorted(r.members for r in out) == [1, 2]


def test_grafts(spark):
    out = ranked(spark, {"audio_seconds": 600.0, "confidence": 0.95, "cover": "own"}, {"audio_seconds": 600.0, "asin": "B000000001", "narrators": ["N"], "cover": "audio", "provider": "audible"})
    assert (out[0].id, out[0].asin, out[0].narrators, out[0].cover) == ("0", "B000000001", ["N"], "own")
    out = ranked(spark, {"confidence": 0.95, "cover": "print"}, {"asin": "B000000001", "audio_seconds": 0.0, "cover": "audio"}, {"asin": "B000000001", "confidence": 0.5})
    assert {r.id: r.cover for r in out} == {"0": "print", "1": "audio"}


def test_junk_never_beats_a_sound_edition_nor_gives_to_it(spark):
    out = ranked(spark, {"audio_seconds": 600.0, "confidence": 1.0, "junk": True, "pinned": True, "asin": "B000000001", "narrators": ["Virtual Voice"]}, {"audio_seconds": 600.0, "confidence": 0.7})
    assert (out[0].id, out[0].asin, out[0].narrators) == ("1", None, [])


def test_ranking_levels(spark):
    rows = [{"title": f"t{i}", **x} for i, x in enumerate([{"confidence": 0.95}, {"confidence": 0.87, "narrators": ["N"]}, {"confidence": 0.5, "pinned": True}, {"confidence": 0.86, "provider": "audible", "language_conflict": True}])]
    assert [r.id for r in ranked(spark, *rows)] == ["2", "1", "0", "3"]


def test_confidence_at_the_floor(spark):
    f = lambda *c: spark.range(1).select(*c).first()
    none = dict(pinned=F.lit(False), delta=F.lit(None).cast("double"), language_conflict=F.lit(False), foreign=F.lit(False), bundle=F.lit(True), ai=F.lit(False), volume=F.lit(False))
    authored = scoring.penalised(scoring.confidence(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double")), authorless=F.lit(False), **none)
    authorless = scoring.penalised(scoring.confidence(F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double")), authorless=F.lit(True), **none)
    a, b = f(authored, authorless)
    assert a >= scoring.FLOOR > b


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_bound_holds(a, b):
    n = len(a) + len(b)
    assert SequenceMatcher(None, a, b, autojunk=False).ratio() <= (2 * min(len(a), len(b)) / n if n else 1) + 1e-12


def test_similarity(spark):
    df = spark.createDataFrame([("Dune", "Dune"), ("Dune: x", "Dune (y)"), ("日本", "東京"), ("", "a"), (None, "a")], "a string, b string")
    got = {(r.a, r.b): (r.s, r.t) for r in with_title_similarity(with_similarity(df, "a", "b", "s"), "a", "b", "t").collect()}
    assert got["Dune", "Dune"] == (1.0, 1.0) and got["Dune: x", "Dune (y)"][1] == 1.0
    assert got["日本", "東京"] == (1.0, 1.0) and got["", "a"] == (0.0, 0.0)


def test_records(spark):
    raw = '{"asin":"B0000000A1","authors":[{"name":"Ann"}],"title":"T","language":"english","release_date":"2018-02-20","rating":{"overall_distribution":{"display_average_rating":"4.5"}},"copyright":"©2018 X","category_ladders":[{"ladder":[{"id":"1234567890","name":"G"},{"id":"1234567891","name":"S"}]},{"ladder":[{"id":"1234567892","name":"G"}]}],"series":[{"title":"P","sequence":"1"},{"title":"Q"}],"publication_name":"P","product_images":{"500":"u._SL5_.jpg"},"thesaurus_subject_keywords":["nonfiction"]}'
    good, bad = records.books(spark.createDataFrame([(raw,), ('{"asin":"bad"}',), ("{broken",)], "json string"))
    b = good.first()
    assert (b.copyright, b.image, b.literatureType, b.seriesPrimary.name, b.seriesSecondary.name, b.rating) == (2018, "u.jpg", "fiction", "P", "Q", "4.5")
    assert [(g.asin, g.name, g.type) for g in b.genres] == [("1234567892", "G", "genre"), ("1234567891", "S", "tag")]
    assert good.count() == 1 and {r.issues[0] for r in bad.collect()} == {"asin"}
    page = spark.createDataFrame([('<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Audiobook","n":1}]</script>',)], "h string")
    assert '"n":1' in page.select(records.json_ld_audiobook(F.col("h"))).first()[0]
    assert spark.createDataFrame([("01:02:03",), ("02:03",), ("x",), ("0:0",)], "d string").select(records.duration_seconds(F.col("d"))).collect() == [(3723,), (123,), (None,), (None,)]


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "k int, v string")
    out = {r.k: (r.action, r.v) for r in store.upsert_actions(old, new, ["k"], ["v"], lambda p: F.col(f"{p}v").isNotNull()).collect()}
    assert out == {1: ("noop", "a"), 2: ("keep", "b"), 3: ("stay", "c"), 4: ("insert", "d")}
    probes = spark.sql("SELECT 'k' AS key, TIMESTAMP '2024-01-01 00:00:10' AS ts UNION ALL SELECT 'k', TIMESTAMP '2024-01-01 00:02:00' UNION ALL SELECT 'z', TIMESTAMP '2024-01-01 00:00:00'")
    writes = spark.sql("SELECT 'k' AS key, TIMESTAMP '2024-01-01 00:00:00' AS ts")
    assert sorted((r.key, r.hit) for r in store.cache_split(probes, writes, 60).collect()) == [("k", False), ("k", True), ("z", False)]


def test_breaker_fold_equals_its_stream_step(spark):
    rows = [(1, t, t, t % 3 > 0) for t in range(0, 400, 7)]
    df = spark.createDataFrame(rows, "k long, s long, o long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = breaker.fold(df, "k", "ts", "o", F.col("failed")).first()
    state = (0, 0, 0, 0, 0, 0)
    for _, s, _, failed in rows:
        state = breaker.advance(state, s * 1_000_000, failed)
    assert (got.mode, got.rejected, got.trips) == (state[0], state[4], state[5]) and got.trips > 0


def test_components_join_over_any_key(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["c"])], "n long, k array<string>")
    assert {r.node: r.component for r in key_components(df, "n", "k").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
