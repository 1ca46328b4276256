"""Queries of provider snapshots, dispatch by id, cached values, merging and ranking, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import handler, store
from ..operators.dedupe import dedupe_and_rank
from ..sources import providers
from ..sources.tables import table
from .catalogue import query
from .scoring_queries import _candidates

c = F.col
_WANT = "CASE o_custkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'de' ELSE 'mars' END"


@query(f"""
WITH e AS (SELECT o_orderkey, l_partkey, l_quantity, CASE l_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang, CASE {_WANT} WHEN 'us' THEN 'en' WHEN 'de' THEN 'de' END AS want FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25),
f AS (SELECT *, coalesce(want IS NULL OR lang IS NULL OR lang = want, false) AS fits FROM e), g AS (SELECT *, bool_or(fits) OVER (PARTITION BY o_orderkey) AS any_ FROM f),
r AS (SELECT concat('hardcover-edition-', l_partkey) AS id, CASE WHEN l_partkey % 4 = 0 THEN concat('B', lpad(l_partkey::VARCHAR, 9, '0')) END AS asin, (l_quantity::INT * 60)::DOUBLE AS audio_seconds, lang AS language, CASE WHEN l_partkey % 5 = 0 THEN 'Editor' ELSE 'Writer' END AS author, CASE WHEN l_partkey % 5 = 0 THEN 'Teller' END AS narrator FROM g WHERE fits OR NOT any_
 UNION ALL SELECT concat('hardcover-book-', o_orderkey), NULL, NULL, NULL, 'Writer', NULL FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e))
SELECT id, asin, audio_seconds, language, author, narrator, count(*) AS n FROM r GROUP BY ALL""")
def p6_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with nested editions through the provider: those in a fitting language, all where none fits, the book itself without any."""
    person = lambda name, role: F.struct(F.struct(F.lit(name).alias("name")).alias("author"), F.lit(role).alias("contribution"))
    none = F.array().cast("array<struct<author:struct<name:string>,contribution:string>>")
    k = c("l_partkey")
    edition = F.struct(
        k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0"))).alias("asin"), (c("l_quantity").cast("int") * 60).alias("audio_seconds"),
        F.when(k % 5 == 0, F.array(person("Editor", None), person("Teller", "Narrator"))).otherwise(none).alias("contributions"), F.struct(F.lit(None).cast("string").alias("url")).alias("cached_image"),
        F.when(k % 3 == 0, F.struct(F.lit("English").alias("language"))).when(k % 3 == 1, F.struct(F.lit("German").alias("language"))).alias("language"),
    )
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", k, edition.alias("e")))).alias("x"))
    books = table(spark, sf_dir, "orders").join(items, c("o_orderkey") == c("l_orderkey"), "left")
    answers = books.select(
        c("o_custkey").alias("query_id"), F.expr(_WANT).alias("region"), F.lit(0).alias("item_pos"), c("o_orderkey").alias("id"), F.lit("T").alias("title"), F.array(person("Writer", None)).alias("contributions"),
        F.struct(F.lit("b").alias("url")).alias("cached_image"), F.transform("x", lambda x: x["e"]).alias("editions"),
    )
    found = providers.hardcover(answers)
    return found.groupBy("id", "asin", "audio_seconds", "language", F.get("authors", F.lit(0)).alias("author"), F.get("narrators", F.lit(0)).alias("narrator")).agg(F.count("*").alias("n"))


_TONGUE = "CASE p_partkey % 7 WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' WHEN 2 THEN '{2}' WHEN 3 THEN NULL ELSE '{1}' END"
_CODE = _TONGUE.format("en", "de", "fr")


@query(f"""
WITH p AS (SELECT *, p_partkey AS k, p_size AS query_id, CASE WHEN p_size % 2 = 0 THEN 'en' WHEN p_size % 3 = 0 THEN 'de' END AS want, {_CODE} AS lang FROM part),
st AS (SELECT *, bool_or(want IS NULL OR lang IS NULL OR lang = want) OVER (PARTITION BY query_id) AS some_ FROM p WHERE k % 4 = 2),
s8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS r FROM st WHERE (coalesce(want IS NULL OR lang IS NULL OR lang = want, false) OR NOT coalesce(some_, false)) AND k % 10 > 0)
SELECT query_id, 0 AS provider_pos, 'audible' AS provider, concat('B', lpad(k::VARCHAR, 9, '0')) AS id, p_name AS title, CASE WHEN k % 8 = 0 THEN 0 ELSE 1 END AS n_authors, (p_size * 60)::DOUBLE AS audio_seconds, CASE WHEN k % 16 = 0 THEN concat('s', k) ELSE concat('l', k) END AS cover, lang AS language FROM p WHERE k % 4 = 0 AND k % 12 > 0
UNION ALL SELECT query_id, 2, 'apple', concat('apple-audiobook-', k), p_name, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END, NULL, CASE WHEN k % 3 > 0 THEN concat('http://i/', k, '/600x600bb.jpg') END, NULL FROM p WHERE k % 4 = 1 AND k % 7 > 0
UNION ALL SELECT query_id, 3, 'storytel', concat('storytel-', k), p_name, 1, CASE WHEN p_size % 4 > 0 THEN p_size * 2::DOUBLE END, CASE WHEN k % 3 = 0 THEN concat('http://c/', k) ELSE concat('https://www.storytel.com/c/', k) END, lang FROM s8 WHERE r <= 8
UNION ALL SELECT query_id, 5, 'openlibrary', concat('openlibrary-works-OL', k, 'W'), CASE WHEN k % 8 = 3 THEN concat(upper(p_name[1]), substr(split_part(p_name, ' ', 1), 2), ' ', upper(split_part(p_name, ' ', 2)[1]), substr(split_part(p_name, ' ', 2), 2)) ELSE concat('the Big ', p_name) END, 1, NULL, CASE WHEN k % 5 > 0 THEN concat('https://covers.openlibrary.org/b/id/', k, '-L.jpg') END, lang FROM p WHERE k % 4 = 3""")
def j14_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four providers, each in its own shape, as candidates of one, in the order of the registry."""
    k = c("p_partkey")
    part = table(spark, sf_dir, "part")
    base = part.withColumns({"query_id": c("p_size").cast("long"), "region": F.when(c("p_size") % 2 == 0, "us").when(c("p_size") % 3 == 0, "de").otherwise("mars"), "item_pos": k.cast("int")})
    spoken = lambda *names: F.expr(_TONGUE.format(*names))
    named = lambda name: F.struct(name.alias("name"))
    images = F.when(k % 16 == 0, F.create_map(F.lit("500"), F.concat(F.lit("s"), k.cast("string")))).otherwise(F.create_map(F.lit("1024"), F.concat(F.lit("l"), k.cast("string")), F.lit("500"), F.lit("x")))
    writer = F.array(named(F.col("p_brand")))
    audible = base.filter(k % 4 == 0).select(
        "query_id", "region", "item_pos", F.when(k % 12 > 0, F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0"))).alias("asin"), c("p_name").alias("title"), F.when(k % 8 == 0, F.array(named(F.lit("")))).otherwise(writer).alias("authors"), writer.alias("narrators"),
        c("p_size").alias("runtime_length_min"), images.alias("product_images"), spoken("english", "german", "french").alias("language"),
    )
    art = F.when(k % 3 > 0, F.concat(F.lit("http://i/"), k.cast("string"), F.lit("/100x100bb.jpg")))
    apple = base.filter(k % 4 == 1).select("query_id", "region", "item_pos", F.when(k % 7 > 0, k).alias("collectionId"), F.concat("p_name", F.lit(" (Unabridged)")).alias("collectionName"), F.when(k % 5 > 0, c("p_brand")).alias("artistName"), art.alias("artworkUrl100"))
    cover = F.concat(F.when(k % 3 == 0, "http://c/").otherwise("/c/"), k.cast("string"))
    book = F.struct(c("p_name").alias("name"), k.cast("string").alias("consumableId"), writer.alias("authors"), cover.alias("largeCover"), F.struct(spoken("en", "de", "fr").alias("isoValue")).alias("language"))
    abook = F.when(k % 10 > 0, F.struct(writer.alias("narrators"), F.when(c("p_size") % 4 > 0, c("p_size").cast("long") * 2000).alias("length")))
    storytel = base.filter(k % 4 == 2).select("query_id", "region", "item_pos", book.alias("book"), abook.alias("abook"))
    title = F.when(k % 8 == 3, c("p_name")).otherwise(F.concat(F.lit("the Big "), "p_name"))
    openlibrary = base.filter(k % 4 == 3).select("query_id", "region", "item_pos", F.concat(F.lit("/works/OL"), k.cast("string"), F.lit("W")).alias("key"), title.alias("title"), F.array("p_brand").alias("author_name"), F.when(k % 5 > 0, k).alias("cover_i"), F.array(spoken("eng", "ger", "fre")).alias("language"))
    found = providers.default_registry().fan_out({"audible": audible, "apple": apple, "storytel": storytel, "openlibrary": openlibrary})
    return found.select("query_id", "provider_pos", "provider", "id", "title", F.size("authors").alias("n_authors"), "audio_seconds", "cover", "language")


@query("""
WITH m AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey % 3 > 0 AND o_orderpriority NOT LIKE '5%')
SELECT query_id, concat('overdrive-', id) AS id, CASE id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END AS language, CASE WHEN id % 2 = 0 THEN 3723.0::DOUBLE END AS audio_seconds FROM m WHERE pos < 5""")
def a14_library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library's first five audiobooks of each query, their first language and first known duration."""
    k = c("o_orderkey")
    spoken = F.when(c("o_orderpriority").startswith("5"), "ebook-overdrive").otherwise("audiobook-overdrive")
    form = lambda kind, t: F.struct(kind.alias("id"), t.alias("duration"))
    language = lambda i, name: F.struct(i.cast("string").alias("id"), name.cast("string").alias("name"))
    other = language(F.lit("it"), F.lit("Italian"))
    first = F.when(k % 4 == 0, F.array(language(F.lit("de"), F.lit("English")), other)).when(k % 4 == 1, F.array(language(F.lit(None), F.lit("English")), other)).when(k % 4 == 2, F.array(language(F.lit("fr"), F.lit(None))))
    media = table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("query_id"), F.when(k % 3 == 0, "elsewhere").otherwise("here").alias("library"), F.lit("us").alias("region"), F.struct("o_orderdate", k).alias("item_pos"), k.cast("string").alias("id"), F.lit('{"main":"T"}').alias("title"),
        F.array(F.struct(F.lit("Ann").alias("name"), F.lit("Author").alias("role"))).alias("creators"), F.array(form(spoken, F.lit(None).cast("string")), form(F.lit("x"), F.when(k % 2 == 0, "01:02:03"))).alias("formats"),
        F.create_map(F.lit("a"), F.struct(F.lit("h").alias("href"), F.lit(3).alias("width"))).alias("covers"), first.alias("languages"),
    )
    return providers.overdrive(providers.library_page(media, "here")).select("query_id", "id", "language", "audio_seconds")


_ID = "CASE p_partkey % 8 WHEN 0 THEN concat('B', lpad(cast(p_partkey AS STRING), 9, '0')) WHEN 1 THEN concat('hardcover-book-', p_partkey) WHEN 2 THEN concat('hardcover-edition-', p_partkey) WHEN 3 THEN concat('storytel-', p_partkey) WHEN 4 THEN concat('openlibrary-works-OL', p_partkey, 'W') WHEN 5 THEN concat('apple-audiobook-', p_partkey) WHEN 6 THEN 'nonsense' END"


@query(f"""
WITH a AS (SELECT p_partkey, {_ID} AS id, p_name FROM part)
SELECT p_partkey, id, CASE WHEN p_partkey % 8 IN (0, 6, 7) THEN 'no id' WHEN p_partkey % 8 IN (4, 5) THEN 'no source' WHEN p_partkey % 5 = 0 OR p_partkey % 8 = 2 AND p_partkey % 3 = 0 THEN 'not found' ELSE 'found' END AS state,
  CASE WHEN p_partkey % 8 IN (1, 2, 3) AND p_partkey % 5 > 0 AND NOT (p_partkey % 8 = 2 AND p_partkey % 3 = 0) THEN p_name END AS title FROM a""")
def j13_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records behind ids of several providers: each id decoded, and looked up by its provider, kind and own id."""
    part = table(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.expr(_ID).alias("id"))
    # What the providers have: editions and books share numbers, only some of both exist.
    own = lambda kind, keep: part.filter("p_partkey % 5 > 0").filter(keep).select(c("p_partkey").cast("string").alias("native"), F.lit(kind).alias("kind"), c("p_name").alias("title"))
    books = {"hardcover": own("book", "true").unionByName(own("edition", "p_partkey % 3 > 0")), "storytel": own("book", "true")}
    return providers.dispatch(asked, "id", books).select("p_partkey", "id", "state", "title")


@query("""
WITH j AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 7 = 0 THEN '{broken' WHEN event_id % 3 = 0 THEN concat('{"asin":"B', event_id, '","releaseDate":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '"}') WHEN event_id % 3 = 1 THEN concat('{"asin":"B', event_id, '","releaseDate":""}') ELSE concat('{"asin":"B', event_id, '"}') END AS body FROM events),
l AS (SELECT user_id, arg_max(body, (ts, event_id)) AS body, max(ts) AS ts FROM j GROUP BY user_id)
SELECT user_id, json_extract_string(body, '$.asin') AS asin, epoch(nullif(json_extract_string(body, '$.releaseDate'), '')::TIMESTAMP)::BIGINT AS released FROM l WHERE json_valid(body) AND ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def a29_cached_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cached value of each key while it lives, decoded, its release date a time again; what can't be read is no value."""
    e = table(spark, sf_dir, "events").select("user_id", c("ts").cast("timestamp").alias("ts"), "event_id")
    k = c("event_id")
    asin = F.concat(F.lit('{"asin":"B'), k.cast("string"))
    body = F.when(k % 7 == 0, "{broken").when(k % 3 == 0, F.concat(asin, F.lit('","releaseDate":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}'))).when(k % 3 == 1, F.concat(asin, F.lit('","releaseDate":""}'))).otherwise(F.concat(asin, F.lit('"}')))
    now = e.agg(F.max("ts")).first()[0]
    found = store.cached_values(e.select(c("user_id").alias("key"), "ts", c("event_id").alias("seq"), body.alias("body")), "asin STRING, releaseDate STRING", F.lit(now), 2, dates=["releaseDate"])
    return found.select(c("key").alias("user_id"), "asin", F.unix_seconds("releaseDate").alias("released"))


@query("""
WITH RECURSIVE k AS (SELECT p_partkey, p_partkey // 20 AS query_id, p_partkey % 6 AS pp, p_partkey % 20 AS ip, CASE p_size % 3 WHEN 0 THEN 0.65 WHEN 1 THEN 0.8 ELSE 0.95 END AS conf, p_partkey % 29 = 0 AS pinned, p_partkey % 31 = 0 AS junk, p_partkey % 37 = 0 AS bundle, p_partkey % 8 = 0 AS heard,
  (p_size % 7)::DOUBLE / 100 AS delta, CASE WHEN p_partkey % 6 = 0 THEN concat('B', lpad((p_partkey % 40)::VARCHAR, 9, '0')) END AS asin, CASE WHEN p_partkey % 4 = 0 THEN 'Reader' END AS narrator, CASE WHEN p_partkey % 3 <> 0 THEN (p_size % 3 * 60 + 600)::DOUBLE END AS audio,
  CASE WHEN p_partkey % 5 <> 0 THEN concat('c', p_partkey) END AS cover, concat(lower(split_part(p_name, ' ', 2)), '|', lower(p_type)) AS who,
  CASE p_partkey % 6 WHEN 0 THEN 'audible' WHEN 1 THEN 'hardcover' WHEN 2 THEN 'apple' WHEN 3 THEN 'storytel' WHEN 4 THEN 'openlibrary' ELSE 'overdrive' END AS provider, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 9 END AS rank FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pp, ip) AS i FROM k),
ky AS (SELECT query_id, i, concat('a', asin) AS key FROM o WHERE asin IS NOT NULL UNION ALL SELECT query_id, i, concat('d', who, '|', round(audio / 60)::INT) FROM o WHERE audio IS NOT NULL UNION ALL SELECT query_id, i, concat('b', who) FROM o WHERE asin IS NULL AND audio IS NULL),
ed AS (SELECT DISTINCT x.query_id, x.i AS u, y.i AS v FROM ky x JOIN ky y ON x.query_id = y.query_id AND x.key = y.key),
rc AS (SELECT query_id, i AS u, i AS r FROM o UNION SELECT ed.query_id, ed.u, rc.r FROM ed JOIN rc ON rc.query_id = ed.query_id AND rc.u = ed.v),
cl AS (SELECT query_id, u AS i, min(r) AS g FROM rc GROUP BY ALL),
w AS (SELECT o.*, g, (asin IS NOT NULL)::INT + (audio IS NOT NULL)::INT + (narrator IS NOT NULL)::INT + (cover IS NOT NULL)::INT AS full_, cover IS NOT NULL AND (pp IN (0, 2, 3) OR asin IS NOT NULL OR audio IS NOT NULL) AS spoken FROM o JOIN cl USING (query_id, i)),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY pinned AND NOT junk DESC, junk, conf DESC, full_ DESC, i) AS best, row_number() OVER (PARTITION BY query_id, g ORDER BY conf DESC, full_ DESC, i) AS worth FROM w),
m AS (SELECT query_id, g, count(*) AS members, arg_min(asin, worth) FILTER (WHERE NOT junk AND asin IS NOT NULL) AS o_asin, arg_min(narrator, worth) FILTER (WHERE NOT junk AND narrator IS NOT NULL) AS o_narrator, arg_min(cover, worth) FILTER (WHERE spoken) AS o_spoken, arg_min(cover, worth) FILTER (WHERE cover IS NOT NULL) AS o_cover FROM z GROUP BY ALL),
e AS (SELECT z.query_id, z.g, members, z.p_partkey::VARCHAR AS id, provider, coalesce(asin, o_asin) AS asin, coalesce(narrator, o_narrator) AS narrator, CASE WHEN spoken THEN cover ELSE coalesce(o_spoken, cover, o_cover) END AS cover, conf, pinned AND NOT bundle AND NOT junk AS pin, coalesce(audio, 0) > 0 AS timed, heard, delta, rank FROM z JOIN m ON m.query_id = z.query_id AND m.g = z.g WHERE best = 1)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY pin DESC, conf DESC, timed OR narrator IS NOT NULL DESC, heard DESC, delta, rank, g) - 1)::INT AS position, members::INT AS members, id, provider, asin, narrator, cover, conf::DOUBLE AS confidence FROM e""")
def c3_one_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging and ranking where no languages conflict: editions are then components of keys, and the order is that of the rules."""
    conf = F.when(c("p_size") % 3 == 0, F.lit(0.65)).when(c("p_size") % 3 == 1, F.lit(0.8)).otherwise(F.lit(0.95))
    alike = _candidates(spark, sf_dir, conf, 20).withColumns({"language": F.when(c("item_pos") % 2 == 0, "en"), "language_conflict": F.lit(False)})
    sizes = table(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("id"), ((c("p_size") % 7) / F.lit(100.0)).alias("delta"))
    ranked = dedupe_and_rank(alike.drop("delta").join(sizes, "id"))
    return ranked.select("query_id", "position", "members", "id", "provider", "asin", F.get("narrators", F.lit(0)).alias("narrator"), "cover", "confidence")


@query("""
WITH k AS (SELECT p_partkey, p_partkey // 10 AS query_id, p_partkey % 6 AS pp, CASE p_size % 3 WHEN 0 THEN 0.65 WHEN 1 THEN 0.8 ELSE 0.95 END AS conf, p_partkey % 29 = 0 AND p_partkey % 37 <> 0 AND p_partkey % 31 <> 0 AS pin, p_partkey % 7 = 3 AS lang, p_partkey % 3 <> 0 OR p_partkey % 4 = 0 AS audio, p_partkey % 8 = 0 AS narr, p_size % 7 AS delta,
  CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 9 END AS rank FROM part)
SELECT query_id, p_partkey::VARCHAR AS id, (row_number() OVER (PARTITION BY query_id ORDER BY pin DESC, conf DESC, lang, audio DESC, narr DESC, delta, rank, pp, p_partkey % 10) - 1)::INT AS position FROM k""")
def w1_full_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order of each query's candidates: pin, confidence beyond the tie, language, audio, narrator, running time, source, place."""
    conf = F.when(c("p_size") % 3 == 0, F.lit(0.65)).when(c("p_size") % 3 == 1, F.lit(0.8)).otherwise(F.lit(0.95))
    apart = _candidates(spark, sf_dir, conf, 10).withColumn("title", F.concat(F.lit("t"), "id")).withColumn("asin", F.lit(None).cast("string")).drop("delta")
    sizes = table(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("id"), ((c("p_size") % 7) / F.lit(100.0)).alias("delta"))
    return dedupe_and_rank(apart.join(sizes, "id")).select("query_id", "id", "position")


@query("""
WITH m AS (SELECT max(ts) AS now_ FROM events),
c AS (SELECT user_id, max((ts, event_id)) AS x FROM events WHERE event_type = 'view' GROUP BY user_id), s AS (SELECT user_id, max((ts, event_id)) AS x FROM events WHERE event_type = 'purchase' AND user_id % 4 > 0 GROUP BY user_id), f AS (SELECT user_id, max((ts, event_id)) AS x FROM events WHERE event_type = 'error' AND user_id % 7 > 0 GROUP BY user_id),
j AS (SELECT k.user_id, k.user_id % 3 = 0 AS up, CASE WHEN c.x[1] + INTERVAL 2 DAY > now_ AND c.x[2] % 5 > 0 THEN concat('c', c.x[2]) END AS cv, c.x[1] + INTERVAL 2 DAY AS cu, concat('s', s.x[2]) AS sv, s.x[1] AS sa, concat('f', f.x[2]) AS fv,
  CASE WHEN f.user_id IS NULL THEN 'NOT_FOUND' ELSE CASE f.x[2] % 5 WHEN 0 THEN 'REGION_UNAVAILABLE' WHEN 1 THEN 'PRODUCT_DELISTED' WHEN 2 THEN 'SERVER' END END AS code, s.user_id IS NOT NULL AS has, now_
  FROM (SELECT DISTINCT user_id FROM events) k LEFT JOIN c ON c.user_id = k.user_id LEFT JOIN s ON s.user_id = k.user_id LEFT JOIN f ON f.user_id = k.user_id, m),
h AS (SELECT *, CASE WHEN cv IS NOT NULL AND NOT up THEN 'cache' WHEN has AND NOT up THEN 'store' WHEN has AND sa > now_ - INTERVAL 3 DAY THEN 'recent' WHEN code IS NULL AND has THEN 'updated' WHEN code IS NULL THEN 'created' WHEN has AND code IN ('REGION_UNAVAILABLE', 'PRODUCT_DELISTED') THEN 'kept' ELSE 'failed' END AS how FROM j),
v AS (SELECT *, CASE how WHEN 'cache' THEN cv WHEN 'store' THEN sv WHEN 'recent' THEN sv WHEN 'kept' THEN sv WHEN 'updated' THEN fv WHEN 'created' THEN fv END AS value FROM h)
SELECT user_id AS key, how, value, CASE WHEN how = 'failed' THEN code END AS code, CASE WHEN how IN ('store', 'updated', 'created') THEN value ELSE cv END AS cached, epoch_us(CASE WHEN how IN ('store', 'updated', 'created') THEN now_ + INTERVAL 5 DAY WHEN cv IS NOT NULL THEN cu END) AS until FROM v""")
def c10_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for records of all users: cache, store, update or build, and the cache with its expiry afterwards."""
    e = table(spark, sf_dir, "events").select("user_id", c("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    last = lambda kind, keep: e.filter((c("event_type") == kind) & keep).groupBy(c("user_id").alias("key")).agg(F.max(F.struct("ts", "event_id")).alias("x")).select("key", "x.ts", "x.event_id")
    named = lambda letter: F.concat(F.lit(letter), c("event_id").cast("string"))
    cached = last("view", F.lit(True)).select("key", F.when(c("event_id") % 5 > 0, named("c")).alias("value"), (c("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"))
    stored = last("purchase", c("user_id") % 4 > 0).select("key", named("s").alias("value"), c("ts").alias("updated_at"))
    code = F.when(c("event_id") % 5 == 0, "REGION_UNAVAILABLE").when(c("event_id") % 5 == 1, "PRODUCT_DELISTED").when(c("event_id") % 5 == 2, "SERVER")
    fetched = last("error", c("user_id") % 7 > 0).select("key", named("f").alias("value"), code.alias("code"))
    asked = e.select(c("user_id").alias("key"), (c("user_id") % 3 == 0).alias("update"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    found = handler.answered(asked, cached, stored, fetched, now, days=3)
    return found.select("key", "how", "value", "code", "cached", F.unix_micros("cached_until").alias("until"))
