"""Queries of similarity, scoring, dedupe, ranking and the composite search, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import with_title_similarity
from ..operators import scoring
from ..operators.dedupe import CANDIDATE, dedupe_and_rank
from ..operators.graph import key_components
from ..operators.similarity_join import similar_pairs, similar_titles
from ..sources.tables import cut_lineage, table
from ..streaming import breaker, cache, limits, rings
from ..streaming.run import drained, stream_of
from . import sqltext as S
from .catalogue import query
from .table_queries import z1_breaker  # noqa: F401  (its SQL is shared)
from .catalogue import _SQL

#: All pairs of distinct names: what a similarity join must not lose is judged against these.
NAME_PAIRS = """
nm AS (SELECT DISTINCT p_name FROM part), np AS (SELECT x.p_name AS q, y.p_name AS c FROM nm x, nm y)"""
#: Spellings of a name with letters moved, doubled and left out.
_SPELT = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'e', '') WHEN 2 THEN concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2)), 's') WHEN 3 THEN replace(p_name, 'l', 'll') ELSE concat(substr(p_name, 3), ' ', substr(p_name, 1, 2)) END"


@query(f"""WITH RECURSIVE nm AS (SELECT DISTINCT p_name AS a FROM part), sp AS (SELECT DISTINCT {_SPELT} AS b FROM part), pp AS (SELECT a, b FROM nm, sp), {S.ratio('pp')}
SELECT a AS q, b AS c, round(r, 9) AS r FROM ratios WHERE r >= 0.7""")
def s1_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a name and a spelling whose ratio is 0.7 or more."""
    part = table(spark, sf_dir, "part")
    near = similar_pairs(part.select(F.col("p_name").alias("a")), part.select(F.expr(_SPELT).alias("b")), 0.7)
    return near.select(F.col("a").alias("q"), F.col("b").alias("c"), F.round("r", 9).alias("r"))


@query(f"""WITH RECURSIVE {NAME_PAIRS}, f AS (SELECT concat(q, ': a saga') AS q, concat(c, ' (large print)') AS c FROM np),
g AS (SELECT q, c, {S.clean('q')} AS q1, {S.clean(S.base_title('q'))} AS q2, {S.clean('c')} AS c1, {S.clean(S.base_title('c'))} AS c2 FROM f),
pp AS (SELECT q1 AS a, c1 AS b FROM g UNION SELECT q1, c2 FROM g UNION SELECT q2, c1 FROM g UNION SELECT q2, c2 FROM g), {S.ratio('pp')},
h AS (SELECT q, c, greatest(r1.r, r2.r, r3.r, r4.r) AS sim FROM g JOIN ratios r1 ON r1.a = q1 AND r1.b = c1 JOIN ratios r2 ON r2.a = q1 AND r2.b = c2 JOIN ratios r3 ON r3.a = q2 AND r3.b = c1 JOIN ratios r4 ON r4.a = q2 AND r4.b = c2)
SELECT q, c, round(sim, 9) AS sim FROM h WHERE sim >= 0.7""")
def s3_title_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of titles whose best forms are 0.7 alike or more."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    near = similar_titles(names.select(F.concat("p_name", F.lit(": a saga")).alias("a")), names.select(F.concat("p_name", F.lit(" (large print)")).alias("b")), 0.7)
    return near.select(F.col("a").alias("q"), F.col("b").alias("c"), F.round("sim", 9).alias("sim"))


_CONF = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN authored THEN 0.55::DOUBLE * t + 0.3::DOUBLE * 1.0::DOUBLE + bonus ELSE t + bonus END))"


_SCORES = f"""WITH RECURSIVE j AS (SELECT w.p_partkey AS want, p.p_partkey AS have, w.p_name AS q, p.p_name AS c, w.p_size AS own, p.p_size FROM part w, part p),
pp AS (SELECT DISTINCT q AS a, c AS b FROM j), {S.ratio('pp')},
d AS (SELECT want, have, r AS t, want % 2 = 1 AS authored, abs(own::DOUBLE - p_size) / p_size AS delta FROM j JOIN ratios ON a = q AND b = c),
s AS (SELECT *, CASE WHEN delta <= 0.05::DOUBLE THEN 0.15::DOUBLE WHEN delta > 0.25::DOUBLE THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM d)
SELECT want, have, round({_CONF}, 9) AS confidence, round(delta, 9) AS delta FROM s WHERE {_CONF} >= 0.8::DOUBLE * 0.55::DOUBLE + 0.7::DOUBLE * 0.3::DOUBLE"""


@query(_SCORES)
def s4_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every record, its own size the wanted running time."""
    part = table(spark, sf_dir, "part")
    return _confident(part, part)


@query(_SCORES)
def s4_score_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name that it had while s4_score was a sample."""
    return s4_score(spark, sf_dir)


#: Records of one kind in a list: as many wanted ones meet as many candidates at a time.
MET = 32


def _confident(wanted: DataFrame, part: DataFrame) -> DataFrame:
    """Confidence of every record as a candidate of every wanted one, where it is at or above the floor.

    Names are compared once for each pair of them.  Records alike in all that is
    scored are of one kind; kinds are scored, and only records of kinds that reach
    the floor meet, so the work on records is that of the rows that come out.
    They meet as lists, so what is moved is a list of wanted ones for each kind
    that they reach, not a row for each.
    """
    size = F.col("p_size").cast("double")
    want = wanted.select(F.col("p_partkey").alias("want"), F.struct(F.col("p_name").alias("q"), size.alias("want_size"), (F.col("p_partkey") % 2 == 1).alias("authored")).alias("asked"))
    have = part.select(F.col("p_partkey").alias("have"), F.struct(F.col("p_name").alias("c"), size.alias("have_size")).alias("found"))
    asked, found = (cut_lineage(d.groupBy(c).agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias(f"{c}_id"), c, "n")) for d, c in ((want, "asked"), (have, "found")))
    # A name or record has many candidates, so few rows are much work: they are dealt to all tasks, however small their table is.
    parallel = want.sparkSession.sparkContext.defaultParallelism
    names = asked.select("asked.q").distinct().repartition(4 * parallel, "q").crossJoin(found.select("found.c").distinct())
    compared = with_title_similarity(names, "q", "c", "t")
    reached = F.greatest(scoring.confidence(F.col("t"), F.lit(1.0), F.lit(0.0)), scoring.confidence(F.col("t"), F.lit(None).cast("double"), F.lit(0.0)))
    near = cut_lineage(compared.filter(reached >= scoring.FLOOR))
    met = asked.select("asked_id", "asked.*").repartition(4 * parallel, "asked_id").join(near, "q").join(found.select("found_id", "found.*"), "c")
    author, delta = F.when(F.col("authored"), F.lit(1.0)), scoring.duration_delta(F.col("want_size"), F.col("have_size"))
    scored = met.withColumn("delta", delta).withColumn("confidence", scoring.confidence(F.col("t"), author, F.col("delta"))).filter(F.col("confidence") >= scoring.FLOOR)
    kinds = cut_lineage(scored.select("asked_id", "found_id", F.round("confidence", 9).alias("confidence"), F.round("delta", 9).alias("delta")))
    # Lists of one kind, however many, are dealt over several tasks.
    wants, haves = _lists(want, asked, "asked", "want"), _lists(have, found, "found", "have")
    dealt = wants.select("asked_id", "wants", F.pmod(F.hash("asked_id", "list"), F.lit(parallel)).alias("deal")).repartition(4 * parallel, "asked_id", "deal")
    wanting = dealt.join(kinds, "asked_id").repartition(4 * parallel, "found_id", "deal")
    having = haves.select("found_id", "haves", F.explode(F.sequence(F.lit(0), F.lit(parallel - 1))).alias("deal"))
    # Merged, as lists of one kind then lie side by side; a broadcast table is read all over for every row.  Lists meet, and only then become rows.
    lists = wanting.join(having.hint("merge"), ["found_id", "deal"])
    pairs = lists.withColumn("want", F.explode("wants")).withColumn("have", F.explode("haves"))
    return pairs.select("want", "have", "confidence", "delta")


def _lists(rows: DataFrame, kinds: DataFrame, kind: str, key: str) -> DataFrame:
    """The keys of each kind's records in lists of some MET: kind_id, list, keys; records without a key are in the list null."""
    dealt = rows.join(kinds, kind).withColumn("list", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.ceil(F.col("n") / MET))))
    keys = F.when(F.col("list").isNull(), F.array_repeat(F.first(key), F.count("*").cast("int"))).otherwise(F.collect_list(key))
    return dealt.groupBy(f"{kind}_id", "list").agg(keys.alias(f"{key}s"))


@query("""
WITH f AS (SELECT p_partkey, 0.65::DOUBLE + (p_size % 36)::DOUBLE / 100.0::DOUBLE AS c, p_partkey % 13 = 0 AS pin, p_partkey % 3 = 0 AS authorless, CASE WHEN p_size % 4 > 0 THEN (p_size % 40)::DOUBLE / 100.0::DOUBLE END AS d, p_partkey % 5 = 0 AS lang, p_partkey % 7 = 0 AS foreign_, p_partkey % 11 = 0 AS bundle, p_partkey % 17 = 0 AS ai, p_partkey % 4 = 0 AS vol FROM part),
a AS (SELECT *, CASE WHEN pin THEN 1.0::DOUBLE ELSE c END AS c1 FROM f),
b AS (SELECT *, CASE WHEN authorless AND NOT pin AND NOT coalesce(d <= 0.05::DOUBLE, false) THEN least(c1, 0.85::DOUBLE) ELSE c1 END AS c2 FROM a),
e AS (SELECT *, CASE WHEN NOT pin AND (lang OR foreign_) THEN greatest(0.0::DOUBLE, c2 - 0.15::DOUBLE) ELSE c2 END AS c3 FROM b),
g AS (SELECT *, CASE WHEN bundle THEN greatest(0.0::DOUBLE, c3 - 0.2::DOUBLE) ELSE c3 END AS c4 FROM e),
h AS (SELECT *, CASE WHEN ai THEN greatest(0.0::DOUBLE, c4 - 0.2::DOUBLE) ELSE c4 END AS c5 FROM g),
i AS (SELECT *, CASE WHEN NOT pin AND vol THEN greatest(0.0::DOUBLE, c5 - 0.2::DOUBLE) ELSE c5 END AS c6 FROM h)
SELECT p_partkey, round(CASE WHEN NOT pin AND d > 0.05::DOUBLE AND d <= 0.25::DOUBLE THEN greatest(0.0::DOUBLE, c6 - 0.3::DOUBLE * (d - 0.05::DOUBLE) / 0.2::DOUBLE) ELSE c6 END, 9) AS confidence FROM i""")
def s7_s13_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    every = lambda n: k % n == 0
    delta = F.when(size % 4 > 0, (size % 40) / F.lit(100.0))
    c = scoring.penalised(F.lit(0.65) + (size % 36) / F.lit(100.0), pinned=every(13), authorless=every(3), delta=delta, language_conflict=every(5), foreign=every(7), bundle=every(11), ai=every(17), volume=every(4))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c, 9).alias("confidence"))


@query(f"""WITH RECURSIVE {NAME_PAIRS}, f AS (SELECT concat('The ', q) AS q, c FROM np), pp AS (SELECT DISTINCT {S.clean('q')} AS a, {S.clean('c')} AS b FROM f), {S.ratio('pp')},
s AS (SELECT q, c, 0.55::DOUBLE * r + 0.3::DOUBLE * 1.0::DOUBLE + 0.0::DOUBLE AS confidence FROM f JOIN ratios ON a = {S.clean('q')} AND b = {S.clean('c')}),
n AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)
SELECT q, c AS title, round(confidence, 9) AS confidence, n AS records FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY confidence DESC, c) AS r FROM s WHERE confidence >= 0.8::DOUBLE * 0.55::DOUBLE + 0.7::DOUBLE * 0.3::DOUBLE) JOIN n ON p_name = c WHERE r = 1""")
def j2_fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: noisy catalogue titles normalised, joined by similarity, scored, floored; the best title of each query.

    Titles are made distinct before they meet; the least similarity that can reach
    the floor is the join's threshold, so no pair above the floor is lost.
    """
    part = table(spark, sf_dir, "part")
    titles = part.select(T.normalize_title(F.concat("p_name", F.lit(", Book "), F.col("p_size").cast("string"))).alias("title")).groupBy("title").agg(F.count("*").alias("records"))
    wanted = part.select(F.concat(F.lit("The "), "p_name").alias("a")).distinct()
    near = similar_titles(wanted, titles.select(F.col("title").alias("b")), (scoring.FLOOR - 0.3) / 0.55 - 1e-9)
    scored = near.select(F.col("a").alias("q"), F.col("b").alias("title"), scoring.confidence(F.col("sim"), F.lit(1.0), F.lit(None).cast("double")).alias("confidence")).filter(F.col("confidence") >= scoring.FLOOR)
    best = scored.groupBy("q").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "title")).alias("b"))
    return best.select("q", F.col("b.title").alias("title"), F.round(-F.col("b.c"), 9).alias("confidence")).join(titles, "title")


@query("""
WITH RECURSIVE k AS (SELECT p_partkey, concat('a', p_name, '|', p_brand, '|', p_type) AS key FROM part UNION ALL SELECT p_partkey, concat('b', p_name, '|', p_size, '|', p_type, '|', p_partkey % 3) FROM part),
e AS (SELECT DISTINCT x.p_partkey AS u, y.p_partkey AS v FROM k x JOIN k y USING (key)),
r AS (SELECT p_partkey AS u, p_partkey AS c FROM part UNION SELECT e.u, r.c FROM e JOIN r ON r.u = e.v)
SELECT u AS p_partkey, min(c) AS component FROM r GROUP BY u""")
def j3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat_ws
    keys = F.array(F.concat(F.lit("a"), s("|", "p_name", "p_brand", "p_type")), F.concat(F.lit("b"), s("|", "p_name", F.col("p_size").cast("string"), "p_type", (F.col("p_partkey") % 3).cast("string"))))
    part = table(spark, sf_dir, "part").select("p_partkey", keys.alias("keys"))
    return key_components(part, "p_partkey", "keys").select(F.col("node").alias("p_partkey"), "component")


def _candidates(spark: SparkSession, sf_dir: str, confidence, per_query: int) -> DataFrame:
    """Parts as search candidates, `per_query` consecutive ones to a query."""
    k = F.col("p_partkey")
    provider = F.element_at(F.array(*(F.lit(p) for p in ("audible", "hardcover", "apple", "storytel", "openlibrary", "overdrive"))), (k % 6 + 1).cast("int"))
    values = {
        "query_id": F.expr(f"p_partkey div {per_query}"), "provider": provider, "provider_pos": (k % 6).cast("int"), "item_pos": (k % per_query).cast("int"), "id": k.cast("string"),
        "asin": F.when(k % 6 == 0, F.concat(F.lit("B"), F.lpad((k % 40).cast("string"), 9, "0"))), "title": F.get(F.split("p_name", " "), F.lit(1)), "authors": F.array("p_type"),
        "narrators": F.when(k % 4 == 0, F.array(F.lit("Reader"))), "audio_seconds": F.when(k % 3 != 0, (F.col("p_size") % 3 * 60 + 600).cast("double")), "cover": F.when(k % 5 != 0, F.concat(F.lit("c"), k.cast("string"))),
        "language": F.when(k % 7 < 3, F.lit("en")).when(k % 7 == 3, F.lit("de")), "confidence": confidence, "delta": F.when(k % 3 != 0, (F.col("p_size") % 7) / F.lit(100.0)),
        "pinned": k % 29 == 0, "junk": k % 31 == 0, "bundle": k % 37 == 0, "language_conflict": k % 7 == 3, "narrator_match": k % 8 == 0,
    }
    kinds = dict(x.split(" ", 1) for x in CANDIDATE.split(", "))
    return table(spark, sf_dir, "part").select(*(v.cast(kinds[c]).alias(c) for c, v in values.items()))


@query()
def c3_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of each query after merging, what they took over, and their places."""
    ranked = dedupe_and_rank(_candidates(spark, sf_dir, F.lit(0.65) + (F.col("p_size") % 36) / F.lit(100.0), 20))
    return ranked.select("query_id", "position", "members", "id", "provider", "asin", F.array_join("narrators", ";").alias("narrators"), "cover", F.round("confidence", 9).alias("confidence"))


@query("""
WITH c AS (SELECT p_partkey, p_partkey // 10 AS query_id, p_partkey % 6 AS pp, CASE p_size % 3 WHEN 0 THEN 0.65 WHEN 1 THEN 0.8 ELSE 0.95 END AS conf, p_partkey % 29 = 0 AND p_partkey % 37 <> 0 AND p_partkey % 31 <> 0 AS pin, p_partkey % 7 = 3 AS lang, p_partkey % 3 <> 0 OR p_partkey % 4 = 0 AS audio, p_partkey % 8 = 0 AS narr,
  CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 9 END AS rank FROM part)
SELECT query_id, p_partkey::VARCHAR AS id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pin DESC, conf DESC, lang, audio DESC, narr DESC, rank, pp, p_partkey % 10) AS r FROM c) WHERE r = 1""")
def w1_condorcet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each query where each candidate is an edition of its own, without running times to compare."""
    conf = F.when(F.col("p_size") % 3 == 0, F.lit(0.65)).when(F.col("p_size") % 3 == 1, F.lit(0.8)).otherwise(F.lit(0.95))
    apart = _candidates(spark, sf_dir, conf, 10).withColumn("title", F.concat(F.lit("t"), "id")).withColumn("asin", F.lit(None).cast("string")).withColumn("delta", F.lit(None).cast("double"))
    return dedupe_and_rank(apart).filter("position = 0").select("query_id", "id")


@query(_SQL["z1_breaker"])
def z1_breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker as a stateful stream over the event files; equal to the batch fold."""
    events = stream_of(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "error").alias("failed"))
    rows = drained(breaker.stream(events, "user_id"), "update")
    # Of a key's rows the last batch's holds, and in it the one that takes its waiting calls in.
    return rows.groupBy("user_id").agg(F.max_by(F.struct("calls", "rejected", "trips", "mode"), F.struct("batch", "calls")).alias("s")).select("user_id", "s.*")


@query(_SQL["j8_cache_split"])
def z3_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as a stream: probes that find a write of their key younger than two hours; equal to the batch split."""
    kind = F.when(F.col("event_type") == "view", cache.PROBE).when(F.col("event_type").isin("purchase", "signup"), cache.WRITE)
    events = stream_of(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind")).filter("kind IS NOT NULL")
    found = cache.last_found(drained(cache.read_through(events, 7200), "update"))
    return found.groupBy((F.col("how") == cache.HIT).alias("hit")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS at_ FROM events WHERE event_type IN ('view', 'purchase', 'error')),
w AS (SELECT p.event_id, max((w.at_, CASE WHEN w.event_type = 'error' THEN 1 ELSE 0 END, w.event_id)) AS w FROM e p LEFT JOIN e w ON w.user_id = p.user_id AND w.event_type <> 'view' AND w.at_ <= p.at_ WHERE p.event_type = 'view' GROUP BY p.event_id)
SELECT how, count(*) AS n FROM (SELECT CASE WHEN w IS NULL OR w[1] IS NULL OR e.at_ - w[1] > 86400000000 THEN 'absent' WHEN w[2] = 1 THEN 'miss' ELSE 'hit' END AS how FROM w JOIN e USING (event_id)) GROUP BY how""")
def z4_known_misses_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known misses in the cache: a failed lookup is kept for a day like a value, and answers as a miss."""
    kind = F.when(F.col("event_type") == "view", cache.PROBE).when(F.col("event_type") == "purchase", cache.WRITE).when(F.col("event_type") == "error", cache.KNOWN_MISS)
    events = stream_of(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind")).filter("kind IS NOT NULL")
    found = cache.last_found(drained(cache.read_through(events, 86_400), "update"))
    return found.groupBy("how").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS at_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'view'),
f AS (SELECT user_id, r, at_ AS built, true AS own FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.r, CASE WHEN e.at_ - f.built <= 172800000000 THEN f.built ELSE e.at_ END, e.at_ - f.built > 172800000000 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, count_if(own) AS built, count_if(NOT own) AS hits FROM f GROUP BY user_id""")
def c10_read_through_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asks first builds; those who ask within two days find it; then it is built anew."""
    asked = stream_of(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(cache.PROBE).alias("kind"))
    found = cache.last_found(drained(cache.read_through(asked, 172_800, builds=True), "update"))
    return found.groupBy(F.col("key").alias("user_id")).agg(F.count_if(F.col("how") == cache.BUILT).alias("built"), F.count_if(F.col("how") == cache.HIT).alias("hits"))


@query(_SQL["g7_latency"])
def z12_latency_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of all and figures of the last hundred requests of each path, kept as rings by a stream."""
    ok = stream_of(spark, sf_dir, "events").filter("event_type != 'error'").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")
    last = rings.merged(drained(rings.rings(ok, 100), "update"), 100)
    found = last.groupBy(F.col("key").alias("event_type")).agg(F.max("seen").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean"))
    return found


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def w3_recent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty decisions, kept as rings by a stream."""
    every = stream_of(spark, sf_dir, "events").select(F.lit("all").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")
    return rings.merged(drained(rings.rings(every, 50), "update"), 50).select(F.col("id").alias("event_id"), "value")


@query(_SQL["z2_rate_limit"])
def z2_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter over the event stream, complete mode."""
    events = stream_of(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = drained(limits.rate_limit(events, "event_type", "ts", "1 hour", 3), "complete")
    last = rows.filter(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return last.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("over").alias("over"))
