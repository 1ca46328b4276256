"""Further queries: lookups, predicates, scalars, records, enrichment, stores, the composite search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..operators import addresses, authors, enrich, records, refresh, retries, scoring, search, series, store, telemetry
from ..sources.tables import cut_lineage, table
from ..streaming.run import drained, stream_of
from . import sqltext as S
from .catalogue import query


@query("""
WITH hits AS (SELECT p_partkey FROM part WHERE p_name LIKE 'small%' ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
SELECT p_partkey, p_name, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS editions FROM part WHERE p_partkey IN (SELECT p_partkey FROM hits)""")
def a3_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best hits' ids, then their records with nested editions."""
    part = table(spark, sf_dir, "part")
    ids = part.filter("p_name LIKE 'small%'").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey")
    editions = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("editions"))
    found = part.join(ids, "p_partkey", "left_semi").join(editions, F.col("p_partkey") == F.col("l_partkey"), "left")
    return found.select("p_partkey", "p_name", F.coalesce("editions", F.lit(0)).alias("editions"))


_EDITIONS = "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(_EDITIONS)
def a6_edition_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edition with the book it belongs to."""
    eds = table(spark, sf_dir, "lineitem")
    return eds.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query(_EDITIONS)
def a6_edition_parent_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name that it had while a6_edition_parent was a sample."""
    return a6_edition_parent(spark, sf_dir)


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def a7_secondary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each secondary key."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT n_nationkey, r_name, CASE r_regionkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'uk' WHEN 2 THEN 'de' ELSE 'jp' END AS region, CASE r_regionkey % 4 WHEN 2 THEN 'de' WHEN 3 THEN 'ja' ELSE 'en' END AS language FROM nation JOIN region ON n_regionkey = r_regionkey")
def a9_region_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region dimension and its catalogue language."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.element_at(F.array(*map(F.lit, ("us", "uk", "de", "jp"))), (F.col("r_regionkey") % 4 + 1).cast("int"))
    return both.select("n_nationkey", "r_name", region.alias("region"), L.region_language(region).alias("language"))


@query("""
SELECT coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 'PRODUCT_DELISTED' WHEN s IS NULL THEN 'NOT_FOUND' WHEN s <> 'AVAILABLE' THEN 'REGION_UNAVAILABLE' END, 'OK') AS state, count(*) AS n
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'AVAILABLE' WHEN 'O' THEN 'RESTRICTED' END AS s FROM orders) GROUP BY 1""")
def a19_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why products are missing."""
    state = F.when(F.col("o_orderstatus") == "F", "AVAILABLE").when(F.col("o_orderstatus") == "O", "RESTRICTED")
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(enrich.availability(state, F.col("o_orderkey") % 7 == 0), F.lit("OK")).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, region FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'us' ELSE 'de' END AS region, concat('B', lpad((o_orderkey % 50)::VARCHAR, 9, '0')) AS asin FROM orders) WHERE asin = 'B000000007' AND (region IS NULL OR region = 'us')")
def a25_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a key in a region or in none."""
    region = F.when(F.col("o_orderkey") % 3 == 1, "us").when(F.col("o_orderkey") % 3 == 2, "de")
    kept = table(spark, sf_dir, "orders").select("o_orderkey", region.alias("region"), F.concat(F.lit("B"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 9, "0")).alias("asin"))
    return store.lookup(kept, "B000000007", "us").select("o_orderkey", "region")


_PLACES = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders"


@query(_PLACES)
def a27_sorted_scan_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a27_sorted_scan, under the name that it had while that was a sample."""
    return a27_sorted_scan(spark, sf_dir)


@query(_PLACES)
def a27_sorted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys by last update with their places.

    Keys are dealt into ranges of the order; a place is the row's number within
    its range plus the rows of the ranges before it.  The ranges are sampled, so
    they are kept as a table before they are counted.
    """
    order = (F.desc("o_orderdate"), F.asc("o_orderkey"))
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartitionByRange(*order)
    ranged = cut_lineage(keys.withColumn("range", F.spark_partition_id()))
    # One row per range, so this window is small.
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    return ranged.join(F.broadcast(before), "range").select("o_orderkey", place.cast("long").alias("place")).orderBy("place")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderstatus")
def k3_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cascading delete by key leaves."""
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.delete(table(spark, sf_dir, "orders"), gone, ["o_custkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT user_id, arg_max(props, event_id) AS props, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, json_extract(props, '$.k')::BIGINT AS k FROM l WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def k8_ttl_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of each key of a store whose writes live for a day."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    last = e.groupBy("user_id").agg(F.max_by("props", "event_id").alias("props"), F.max("ts").alias("ts"))
    return last.filter(~store.stale(F.col("ts").cast("timestamp"), F.lit(now).cast("timestamp"), 1)).select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, concat('{\"brand\":\"', p_brand, '\",\"name\":\"', p_name, '\",\"size\":', p_size, '}') AS body FROM part")
def k12_sorted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies with keys in alphabetical order."""
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("body"))


#: Titles with marks, and with what only looks like them.
_MARKS = (
    " Gift Set", " (Spanish Edition)", " Books 1-4", ": the Omnibus", " Ausgabe", " Setting", "", " Boxed-Set", " Collection", " Collections", " Book 1-4", " Books 12 – 14", " 3-book set", " Complete Series", " trilogy set", " Edición", " édition française",
    " Polish Version", " Polish Diversion", " English Edition", " Edizione", " Omnibuses", " french  edition", " Box Setup", " Übersausgabe", " Trilogy",
)
_TELLERS = ("Virtual Voice", "A Virtual Voice", "Virtual Voices", "virtual voice (AI)", "Ann Bee")
_MARK_LIST = "[" + ", ".join(f"'{m}'" for m in _MARKS) + "]"
_TELLER_LIST = "[" + ", ".join(f"'{m}'" for m in _TELLERS) + "]"
#: The same marks in DuckDB's dialect.
_BUNDLE_SQL = r"(?i)(^|[^A-Za-z0-9_])(box(ed)?[- ]?set|gift[- ]?set|omnibus|collection|complete series|books? \d+\s*[-–—]\s*\d+|\d+[- ]book set|trilogy set)($|[^A-Za-z0-9_])"
_FOREIGN_SQL = r"(?i)(^|[^A-Za-z0-9_])((spanish|french|german|italian|portuguese|dutch|polish|russian|japanese|chinese|swedish|norwegian|danish|finnish|czech|turkish|korean)\s+(edition|version)|edici[oó]n|[ée]dition\s+fran[cç]aise|ausgabe|edizione)($|[^A-Za-z0-9_])"


@query(f"""
WITH d AS (SELECT concat(p_name, ({_MARK_LIST})[p_partkey % {len(_MARKS)} + 1]) AS title, ({_TELLER_LIST})[p_size % {len(_TELLERS)} + 1] AS teller FROM part)
SELECT title, teller, regexp_matches(title, '{_BUNDLE_SQL}') AS bundle, regexp_matches(title, '{_FOREIGN_SQL}') AS foreign_, regexp_matches(teller, '(?i)(^|[^A-Za-z0-9_])virtual voice($|[^A-Za-z0-9_])') AS ai, count(*) AS n FROM d GROUP BY ALL""")
def f4_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle, foreign edition and synthetic narrator marks of titles and narrators."""
    title = F.concat("p_name", F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("p_partkey") % len(_MARKS) + 1).cast("int")))
    teller = F.element_at(F.array(*map(F.lit, _TELLERS)), (F.col("p_size") % len(_TELLERS) + 1).cast("int"))
    known = table(spark, sf_dir, "part").select(title.alias("title"), teller.alias("teller")).groupBy("title", "teller").agg(F.count("*").alias("n"))
    return known.select("title", "teller", T.is_bundle(F.col("title")).alias("bundle"), T.is_foreign_edition(F.col("title")).alias("foreign_"), T.is_ai_narrated(F.array("teller")).alias("ai"), "n")


_SPELT = "CASE c_custkey % 3 WHEN 0 THEN concat('Jon ', c_mktsegment) WHEN 1 THEN concat('John Q ', c_mktsegment) ELSE concat('Mary ', c_mktsegment) END"


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT c_mktsegment, {_SPELT} AS name FROM customer), j AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y USING (c_mktsegment)),
w AS (SELECT a AS ra, b AS rb, {S.clean('a')} AS a1, {S.clean('b')} AS b1, lower(split_part(a, ' ', 1)) AS a2, lower(split_part(b, ' ', 1)) AS b2 FROM j), pp AS (SELECT a1 AS a, b1 AS b FROM w UNION SELECT a2, b2 FROM w), {S.ratio('pp')}
SELECT ra AS a, rb AS b, x.r >= 0.9 OR y.r >= 0.85 AS same FROM w JOIN ratios x ON x.a = a1 AND x.b = b1 JOIN ratios y ON y.a = a2 AND y.b = b2""")
def f11_same_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of name forms with one last name: one author or not."""
    names = table(spark, sf_dir, "customer").select("c_mktsegment", F.expr(_SPELT).alias("a")).distinct()
    return enrich.same_author(names.join(names.withColumnRenamed("a", "b"), "c_mktsegment").select("a", "b"), "a", "b", "same")


_ASIN = "CASE o_orderkey % 7 WHEN 0 THEN concat('b', lpad(cast(o_orderkey AS STRING), 9, '0')) WHEN 1 THEN cast(o_totalprice AS STRING) WHEN 2 THEN concat('B', cast(o_orderkey AS STRING)) WHEN 3 THEN concat('xB', lpad(cast(o_orderkey AS STRING), 9, 'Q')) ELSE concat('B', lpad(cast(o_orderkey AS STRING), 9, 'Z')) END"
_ASKED = "CASE o_custkey % 8 WHEN 0 THEN 'us' WHEN 1 THEN 'DE' WHEN 2 THEN ' fr ' WHEN 3 THEN 'mars' WHEN 4 THEN '' WHEN 5 THEN 'jp' WHEN 6 THEN NULL ELSE 'es' END"


@query(f"""
WITH d AS (SELECT {_ASIN} AS asin, {_ASKED} AS region FROM orders),
e AS (SELECT regexp_matches(asin, '^B[0-9A-Z]{{9}}$') AS asin_ok, coalesce(lower(trim(region)) IN ('us', 'uk', 'ca', 'au', 'in', 'de', 'es', 'fr', 'it', 'jp'), false) AS region_ok FROM d)
SELECT count(*) AS n, count_if(NOT asin_ok) AS bad_asin, count_if(asin_ok AND NOT region_ok) AS bad_region, count_if(asin_ok AND region_ok) AS good FROM e""")
def f19_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First issue of each request."""
    asked = table(spark, sf_dir, "orders").select(F.expr(_ASIN).alias("asin"), F.expr(_ASKED).alias("region"))
    issues = F.filter(F.array(F.when(~T.is_asin(F.col("asin")), "asin"), F.when(L.region_language(F.col("region")).isNull(), "region")), lambda x: x.isNotNull())
    first = asked.select(F.get(issues, F.lit(0)).alias("issue"))
    return first.agg(F.count("*").alias("n"), F.count_if(F.col("issue") == "asin").alias("bad_asin"), F.count_if(F.col("issue") == "region").alias("bad_region"), F.count_if(F.col("issue").isNull()).alias("good"))


#: Markup that makes a page a book's, and markup that only looks like it.
_PROBES = (
    '<i data-testid="buy-button">', "<i data-testid='chapter-list' x>", "<I DATA-TESTID=sample-button>", '<i data-testid="buy-buttons">', '<p>data-testid="buy-button"</p>', '<!-- <i data-testid="buy-button"> -->', "<button class=x><b>Sam</b>ple</button>", '<button title="Sample">Play</button>',
    "<button>Buy</button> Sample", "<button>sample</button>", '<span class="a bc-button-text">A Sample</span>', '<span class="bc-button-texts">A Sample</span>', '<h1 class="bc-heading x"><span class="bc-text-bold">T</span></h1>', '<h1 class="bc-heading bc-text-bold">T</h1>',
    '<h2 class="bc-heading"><b class="bc-text-bold">T</b></h2>', '<h1 class="bc-heading"></h1><b class="bc-text-bold">T</b>', '<b class="product-listener">', '<b class="x-product-listener">', "<b class='y product-listener z'>", '<b id="product-listener">', "<script>'<b class=product-listener>'</script>", "<p>Sample</p>", "",
)
_PROBED = "element_at(array(" + ", ".join('"' + x.replace('"', '\\"') + '"' for x in _PROBES) + f"), cast(page_id % {len(_PROBES)} + 1 AS INT))"
_PROBE_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _PROBES) + "]"


def _class_sql(name: str) -> str:
    return rf"""\s[cC][lL][aA][sS][sS]\s*=\s*("([^"]*\s)?{name}(\s[^"]*)?"|''([^'']*\s)?{name}(\s[^'']*)?''|{name}[\s>])"""


@query(rf"""
WITH d AS (SELECT page_id, regexp_replace(concat(html, ({_PROBE_LIST})[page_id % {len(_PROBES)} + 1]), '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM pages),
e AS (SELECT page_id, regexp_matches(h, '<[a-zA-Z][^<>]*\s(?i:data-testid)\s*=\s*["'']?(buy-button|sample-button|chapter-list)["''\s>]') OR regexp_matches(h, '<[a-zA-Z][^<>]*{_class_sql("product-listener")}')
  OR regexp_matches(list_aggregate(regexp_extract_all(h, '(?is)<h1\s.*?</h1>'), 'string_agg', chr(10)), '<[hH]1[^<>]*{_class_sql("bc-heading")}[^<>]*>(.|\n)*<[a-zA-Z][^<>]*{_class_sql("bc-text-bold")}') AS marked,
  list_concat(regexp_extract_all(h, '(?is)<button(?:\s[^<>]*)?>.*?</button>'), regexp_extract_all(h, '<span[^<>]*{_class_sql("bc-button-text").replace("(", "(?:")}[^<>]*>[^<]*')) AS labels FROM d)
SELECT page_id, coalesce(marked, false) OR coalesce(list_bool_or(list_transform(labels, lambda x: contains(regexp_replace(x, '<[^>]*>', '', 'g'), 'Sample'))), false) AS book FROM e""")
def f20_page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are books', by their markup; half of the marks added only look like a book's."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", authors.is_book_page(F.concat(F.col("html"), F.expr(_PROBED))).alias("book"))


_KNOWN_MARK = "CASE page_id % 7 WHEN 0 THEN '<i data-testid=\"buy-button\">' WHEN 1 THEN '<button class=x><b>Sample</b></button>' WHEN 2 THEN '<h1 class=\"bc-heading x\"><span class=\"bc-text-bold\">T</span></h1>' WHEN 3 THEN '<ol data-testid=\"chapter-list\">' WHEN 4 THEN '<b class=\"product-listener\">' WHEN 5 THEN '<button>Buy</button> Sample' ELSE '' END"


@query("SELECT page_id % 7 < 5 AS book, count(*) AS n FROM pages GROUP BY 1")
def f20_page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books' pages told from authors' by five probes of their markup."""
    html = F.concat(F.col("html"), F.expr(_KNOWN_MARK))
    return table(spark, sf_dir, "pages").groupBy(authors.is_book_page(html).alias("book")).agg(F.count("*").alias("n"))


#: Callers, some of them no addresses: parts over 255, too few, too many, none, words.
_CALLER = "CASE event_id % 23 WHEN 0 THEN concat('10.0.0.', cast(200 + user_id % 100 AS STRING)) WHEN 1 THEN concat('2560.0.', cast(user_id % 9 AS STRING)) WHEN 2 THEN 'unknown' WHEN 3 THEN NULL WHEN 4 THEN concat('10.1.2.3.', cast(user_id % 9 AS STRING)) ELSE concat(cast(8 + event_id % 4 AS STRING), '.', cast(user_id % 3 AS STRING), '.', cast(event_id % 256 AS STRING), '.', cast(user_id % 256 AS STRING)) END"
#: The first and last address of a block, as numbers, and a caller's, null where it is none.
_NUMBER = "CASE WHEN regexp_matches({x}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AND list_max(list_transform(str_split({x}, '.'), lambda p: p::INT)) <= 255 THEN list_reduce(list_transform(str_split({x}, '.'), lambda p: p::BIGINT), lambda t, p: t * 256 + p) END"


@query(f"""
WITH d AS (SELECT {_CALLER} AS ip FROM events), e AS (SELECT {_NUMBER.format(x='ip')} AS ip FROM d)
SELECT coalesce(ip BETWEEN 167837696 AND 167838719, false) AS narrow, coalesce(ip BETWEEN 167772160 AND 184549375, false) AS wide, count(*) AS n FROM e GROUP BY ALL""")
def f21_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers inside two blocks, 10.1.0.0/22 and 10.0.0.0/8."""
    ip = F.expr(_CALLER)
    return table(spark, sf_dir, "events").groupBy(addresses.allowed(ip, "10.1.0.0/22").alias("narrow"), addresses.allowed(ip, "10.0.0.0/8").alias("wide")).agg(F.count("*").alias("n"))


#: Blocks from the suppliers, hundreds of them nested in one another, some that can't be read.
_BLOCK = "CASE WHEN s_suppkey % 19 = 0 THEN concat('10.0.0.', s_suppkey % 300, '/40') ELSE concat(8 + s_suppkey % 3, '.', s_suppkey % 2, '.', (s_suppkey * 7) % 256, '.', (s_suppkey * 13) % 256, '/', 6 + s_suppkey % 27) END"


@query(f"""
WITH b AS (SELECT DISTINCT {_BLOCK} AS block FROM supplier), p AS (SELECT block, str_split(block, '/')[1] AS base, str_split(block, '/')[2]::INT AS bits FROM b),
r AS (SELECT block, bits, ({_NUMBER.format(x='base')} >> (32 - bits)) << (32 - bits) AS lo, (1::BIGINT << (32 - bits)) AS size FROM p WHERE bits <= 32),
d AS (SELECT {_CALLER} AS ip, count(*) AS n FROM events GROUP BY 1), e AS (SELECT ip, n, {_NUMBER.format(x='ip')} AS at_ FROM d),
f AS (SELECT e.ip, arg_max(block, (bits, -ascii(block))) AS any_, max(bits) AS bits FROM e JOIN r ON at_ BETWEEN lo AND lo + size - 1 GROUP BY e.ip),
g AS (SELECT f.ip, min(block) AS block FROM f JOIN e ON e.ip = f.ip JOIN r ON r.bits = f.bits AND e.at_ BETWEEN lo AND lo + size - 1 GROUP BY f.ip)
SELECT coalesce(block, 'none') AS block, sum(n)::BIGINT AS n FROM e LEFT JOIN g ON g.ip = e.ip GROUP BY 1""")
def f21_block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific block of each caller out of a table of nested blocks."""
    blocks = table(spark, sf_dir, "supplier").select(F.expr(_BLOCK).alias("block"))
    calls = table(spark, sf_dir, "events").select(F.expr(_CALLER).alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
    found = addresses.with_block(calls, "ip", blocks)
    return found.groupBy(F.coalesce("block", F.lit("none")).alias("block")).agg(F.sum("n").alias("n"))


@query("SELECT count(*) AS n, count_if(o_orderkey % 4 <> 1) AS equal_ FROM orders")
def f24_deep_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records that equal their earlier form, nulls included."""
    k = F.col("o_orderkey")
    nested = lambda p: F.struct("o_orderstatus", F.array(F.struct("o_custkey", p.alias("p"))).alias("items"), F.when(k % 2 == 0, F.lit(None)).otherwise(F.lit(1)).alias("x"))
    changed = F.when(k % 4 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_if(nested(F.col("o_totalprice")).eqNullSafe(nested(changed))).alias("equal_"))


@query("""
SELECT p_partkey % 4 > 0 AS valid, count(*) AS n, count_if(p_partkey % 4 > 0 AND p_size % 2 = 0) AS fiction, sum(CASE WHEN p_partkey % 4 > 0 THEN 1900 + p_size ELSE 0 END)::BIGINT AS years FROM part GROUP BY 1""")
def p1_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product documents to book records, those that fail validation apart."""
    k = F.col("p_partkey")
    raw = F.to_json(F.struct(
        F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0")).alias("asin"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("authors"), F.when(k % 4 > 0, F.col("p_name")).alias("title"), F.lit("english").alias("language"),
        F.lit("2020-01-02").alias("release_date"), F.struct(F.struct(F.lit("4.5").alias("display_average_rating")).alias("overall_distribution")).alias("rating"),
        F.concat(F.lit("©"), (F.col("p_size") + 1900).cast("string"), F.lit(" House")).alias("copyright"), F.array(F.when(F.col("p_size") % 2 == 0, F.lit("nonfiction")).otherwise(F.lit("poetry"))).alias("thesaurus_subject_keywords"),
    ))
    good, bad = records.books(table(spark, sf_dir, "part").select(raw.alias("json")))
    one = good.select(F.lit(True).alias("valid"), (F.col("literatureType") == "fiction").alias("fiction"), F.col("copyright").alias("year"))
    both = one.unionByName(bad.select(F.lit(False).alias("valid"), F.lit(False).alias("fiction"), F.lit(0).alias("year")))
    return both.groupBy("valid").agg(F.count("*").alias("n"), F.count_if("fiction").alias("fiction"), F.sum("year").alias("years"))


@query("""
SELECT l_orderkey, count_if(l_returnflag <> 'N') AS authors, count_if(l_returnflag = 'N') AS narrators FROM lineitem GROUP BY l_orderkey""")
def p12_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions parted by role."""
    role = F.when(F.col("l_returnflag") == "N", "Narrated by").otherwise("Author")
    people = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("who"), role.alias("role"))).alias("c"))
    return people.select("l_orderkey", *(F.size(records.by_role(F.col("c"), "role", told)).cast("long").alias(name) for name, told in (("authors", False), ("narrators", True))))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS name, p_size AS size FROM part")
def p14_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records merged: the later one's fields win where it is there, nulls included."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"), "p_type")
    later = part.filter("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 > 0, F.col("p_type")).alias("name"))
    return records.merged(part.drop("p_type"), later, "p_partkey")


@query("""
SELECT p_partkey, p_name AS title, concat('House ', p_brand) AS publisher, concat('https://i/', p_partkey, '/600x600bb.jpg') AS square, concat('https://i/', p_partkey, '.jpg') AS plain, concat_ws('|', 'audible', p_name, p_brand) AS cache_key, 1900 + p_size AS year FROM part""")
def n_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store titles, publishers, cover urls, cache keys."""
    k = F.col("p_partkey").cast("string")
    owner = F.concat(F.lit("©"), (F.col("p_size") + 1900).cast("string"), F.lit(" House "), "p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.clean_store_title(F.concat("p_name", F.lit(" (Unabridged)"))).alias("title"), T.publisher_of_copyright(owner).alias("publisher"), T.square_cover(F.concat(F.lit("https://i/"), k, F.lit("/100x100bb.jpg"))).alias("square"),
        T.drop_image_modifier(F.concat(F.lit("https://i/"), k, F.lit("._SL500_.jpg"))).alias("plain"), F.concat_ws("|", F.lit("audible"), "p_name", "p_brand").alias("cache_key"), T.copyright_year(owner).alias("year"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 20 <= 10 THEN (event_id % 20) * 1000 END ELSE least(2 ** (event_id % 5) * 1000, 8000)::BIGINT END AS delay, format('{:.2f}', round(value, 2)) AS rating, coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'de' END), ''), 'us') AS region FROM events""")
def x17_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry delays, two-decimal ratings, default regions."""
    k = F.col("event_id")
    after = F.when(k % 3 == 0, k % 20)
    region = F.coalesce(F.nullif(F.trim(F.when(k % 2 == 0, " ").otherwise("de")), F.lit("")), F.lit("us"))
    return table(spark, sf_dir, "events").select("event_id", enrich.retry_delay(k % 5, after).alias("delay"), F.format_string("%.2f", "value").alias("rating"), region.alias("region"))


@query("""
SELECT CASE WHEN manual THEN 'manual' WHEN matched AND NOT pinned AND NOT corroborated THEN 'risky' WHEN matched THEN 'safe' ELSE 'none' END AS flag, count(*) AS n FROM (
 SELECT event_type <> 'error' AS matched, user_id % 11 = 0 AS manual, event_type = 'purchase' AS pinned, event_type = 'purchase' OR event_id % 3 = 0 AS corroborated FROM events) GROUP BY 1""")
def s17_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each decision."""
    from .table_queries import _decisions

    risky = F.col("matched") & ~F.col("pinned") & ~F.col("corroborated")
    flag = F.when(F.col("manual"), "manual").when(risky, "risky").when(F.col("matched"), "safe").otherwise("none")
    return _decisions(spark, sf_dir).groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT DISTINCT o_custkey AS work, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey), m AS (SELECT s, count(*) AS members FROM l GROUP BY s),
p AS (SELECT work, l.s, members, CASE WHEN (l.s + work) % 3 = 0 THEN 1 ELSE 0 END AS placed FROM l JOIN m ON m.s = l.s),
r AS (SELECT work, s, row_number() OVER (PARTITION BY work ORDER BY placed DESC, members DESC, s) AS r FROM p)
SELECT work, concat('s', max(s) FILTER (WHERE r = 1)) AS primary_, CASE WHEN count(*) > 1 THEN concat('s', max(s) FILTER (WHERE r = 2)) END AS secondary FROM r GROUP BY work""")
def c4_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of each work: positioned first, then by members."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("work"))
    links = o.join(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s")), F.col("o_orderkey") == F.col("l_orderkey")).select("work", "s").distinct()
    link = F.struct("work", F.when((F.col("s") + F.col("work")) % 3 == 0, "1").otherwise("0").alias("text"), F.lit(None).cast("double").alias("number"))
    name = F.concat(F.lit("s"), F.col("s").cast("string"))
    sizes = links.groupBy(F.col("s").alias("series")).agg(F.count("*").alias("members"))
    found = series.ranked_series(links.select("work", name.alias("name"), F.col("s").alias("series"), F.array(link).alias("links"), F.col("s").alias("pos")), sizes)
    return found.select("work", F.col("primary.name").alias("primary_"), F.col("secondary.name").alias("secondary"))


@query("""
SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('p', s_suppkey) WHEN s_suppkey % 3 = 0 THEN 'old' WHEN s_suppkey % 5 = 0 THEN 'gap' END AS image, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'old' END AS image_alt FROM supplier""")
def c5_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author images from a preferred source, the stored record and a source that fills gaps."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description"))
    old = s.withColumn("image", F.when(k % 3 == 0, "old"))
    preferred = s.filter("s_suppkey % 2 = 0").withColumn("image", F.concat(F.lit("p"), k.cast("string")))
    gaps = s.filter("s_suppkey % 5 = 0").withColumn("image", F.lit("gap"))
    return enrich.author_profiles(old.drop("s_suppkey"), preferred, gaps).select("name", "image", "image_alt")


_COVERS = "SELECT p_name AS record, concat('c', min(p_partkey)) AS cover FROM part GROUP BY p_name"


@query(_COVERS)
def c6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cover of every title."""
    return _covers(table(spark, sf_dir, "part"))


@query(_COVERS)
def c6_cover_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name that it had while c6_cover was a sample."""
    return c6_cover(spark, sf_dir)


def _covers(part: DataFrame) -> DataFrame:
    """Best cover of each title, the first of equals."""
    hits = part.select(F.col("p_name").alias("record"), F.col("p_name").alias("title"), F.lit("Ann").alias("author"), F.col("p_name").alias("hit_title"), F.lit("Ann").alias("hit_author"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("cover"), F.col("p_partkey").alias("pos"))
    return enrich.square_cover(hits)


@query("""
SELECT name, min(c_custkey) AS c_custkey FROM (SELECT lower(c_mktsegment) AS name, c_custkey FROM customer) GROUP BY name""")
def c8_one_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First author of each name, spelling of case and blanks aside."""
    spelt = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")))
    one = enrich.one_per_name(table(spark, sf_dir, "customer").select(spelt.alias("name"), "c_custkey", F.col("c_custkey").alias("pos")))
    return one.select(T.normalize_name(F.col("name")).alias("name"), "c_custkey")


@query("""
SELECT CASE WHEN user_id % 3 = 0 THEN 'cache' WHEN user_id % 3 = 1 AND user_id % 5 <> 0 THEN 'store' WHEN user_id % 7 = 0 THEN 'missing' ELSE 'built' END AS how, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1""")
def c10_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each key's record comes from: cache, store, or built anew."""
    keys = table(spark, sf_dir, "events").select("user_id").distinct()
    cache = keys.filter("user_id % 3 = 0").withColumn("how", F.lit("cache"))
    kept = keys.filter("user_id % 3 = 1 AND user_id % 5 != 0").withColumn("how", F.lit("store"))
    built = keys.filter("user_id % 7 != 0").withColumn("how", F.lit("built"))
    found = store.first_of(keys, [cache, kept, built], "user_id", "how")
    return found.groupBy(F.coalesce("how", F.lit("missing")).alias("how")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'listed' WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS genres FROM orders""")
def c11_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres from the page only where the document has none."""
    o = table(spark, sf_dir, "orders")
    own = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.array(F.lit("listed"))).when(F.col("o_orderkey") % 9 > 0, F.array().cast("array<string>")).alias("genres"))
    pages = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.array("o_orderpriority").alias("genres"))
    return records.with_page_genres(own, pages, "o_orderkey").select("o_orderkey", F.get("genres", F.lit(0)).alias("genres"))


@query("""
SELECT kind, count(*) AS n FROM (SELECT 'author' AS kind, o_custkey AS k FROM orders GROUP BY o_custkey HAVING max(o_orderdate) <= TIMESTAMP '1999-06-01' UNION ALL SELECT 'book', o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-01') GROUP BY kind""")
def c12_refresh_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records due for a refresh, authors before books."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    now = F.to_timestamp(F.lit("1999-06-08"))
    authors = o.groupBy("o_custkey").agg(F.max("at").alias("at")).filter(store.stale(F.col("at"), now)).select(F.lit("author").alias("kind"))
    return authors.unionByName(o.filter(store.stale(F.col("at"), now)).select(F.lit("book").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


_REGION = "CASE n_regionkey WHEN 0 THEN 'us' WHEN 1 THEN 'uk' WHEN 2 THEN 'de' WHEN 3 THEN 'us' ELSE 'jp' END"


@query(f"""
WITH c AS (SELECT c_custkey AS id, {_REGION} AS region, max(o_orderdate) AS at_, c_custkey % 9 = 4 AS failed FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
o AS (SELECT o_orderkey AS id, o_custkey AS parent, region, o_orderdate AS at_, o_orderkey % 11 = 5 AS failed FROM orders JOIN c ON c.id = o_custkey),
l AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS parent, region, CASE WHEN l_quantity > 25 THEN max(l_shipdate) END AS at_, bool_or(l_partkey % 13 = 6) AS failed FROM lineitem JOIN o ON o.id = l_orderkey GROUP BY l_orderkey, l_linenumber, region, l_quantity > 25),
l1 AS (SELECT id, parent, region, max(at_) AS at_, bool_or(failed) AS failed FROM l GROUP BY ALL),
w0 AS (SELECT 0 AS wave, id, region, at_, failed, 'stale' AS cause FROM c WHERE coalesce(at_ <= TIMESTAMP '1999-05-25', true)),
w1 AS (SELECT 1 AS wave, id, region, at_, failed, CASE WHEN at_ <= TIMESTAMP '1999-05-25' THEN 'stale' ELSE 'parent' END AS cause FROM o WHERE at_ <= TIMESTAMP '1999-05-25' OR parent IN (SELECT id FROM w0 WHERE NOT failed)),
w2 AS (SELECT 2 AS wave, id, region, at_, failed, CASE WHEN coalesce(at_ <= TIMESTAMP '1999-05-25', true) THEN 'stale' ELSE 'parent' END AS cause FROM l1 WHERE coalesce(at_ <= TIMESTAMP '1999-05-25', true) OR parent IN (SELECT id FROM w1 WHERE NOT failed)),
u AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2),
n AS (SELECT wave, id, region, cause, failed, row_number() OVER (PARTITION BY wave, region ORDER BY at_ NULLS FIRST, id) - 1 AS n FROM u)
SELECT wave, id, region, cause, failed, n // 5 AS round, (n % 5)::INT AS slot FROM n""")
def c12_refresh_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole refresh: stale authors, their books, these books' chapters; each with its wave, and its round and slot in its region."""
    t = lambda name: table(spark, sf_dir, name)
    at = lambda c: F.col(c).cast("timestamp")
    o = t("orders").select("o_orderkey", "o_custkey", at("o_orderdate").alias("updated_at"))
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.expr(_REGION).alias("region"), (F.col("c_custkey") % 9 == 4).alias("failed"))
    last = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("updated_at").alias("updated_at"))
    books = o.join(people.select(F.col("id").alias("o_custkey"), "region"), "o_custkey").select(F.col("o_orderkey").alias("id"), "o_custkey", "region", "updated_at", (F.col("o_orderkey") % 11 == 5).alias("failed"))
    number = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    items = t("lineitem").groupBy(number.alias("id"), F.col("l_orderkey").alias("parent")).agg(F.max(F.when(F.col("l_quantity") > 25, at("l_shipdate"))).alias("updated_at"), F.max(F.col("l_partkey") % 13 == 6).alias("failed"))
    # Chapters are read twice, as records and as links.
    chapters = cut_lineage(items.join(books.select(F.col("id").alias("parent"), "region"), "parent"))
    work = refresh.waves(
        {"author": people.join(last, "id", "left"), "book": books.drop("o_custkey"), "chapter": chapters.drop("parent")},
        {"book": books.select(F.col("o_custkey").alias("parent"), "id"), "chapter": chapters.select("parent", "id")},
        F.to_timestamp(F.lit("1999-06-01")),
    )
    return refresh.scheduled(work).select("wave", "id", "region", "cause", "failed", "round", "slot")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most FROM events GROUP BY event_type")
def z11_metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running request aggregates over the event stream."""
    e = stream_of(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    rows = drained(e, "complete")
    last = rows.agg(F.max("batch")).first()[0] or 0
    return rows.filter(F.col("batch") == last).select("event_type", "n", F.round("total", 2).alias("total"), "most")


@query(r"""
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN 500 WHEN 'signup' THEN NULL ELSE 200 END AS status, json_extract(props, '$.k')::INT AS k FROM events),
h AS (SELECT *, CASE k % 5 WHEN 0 THEN concat(k // 5, 's') WHEN 1 THEN strftime(ts + to_seconds(k // 5 - 5), '%a, %d %b %Y %H:%M:%S GMT') WHEN 2 THEN 'soon' WHEN 3 THEN concat('-', k) END AS header FROM e),
a AS (SELECT *, try_cast(regexp_extract(header, '^[0-9]+') AS BIGINT) AS seconds, epoch_us(try_strptime(header, '%a, %d %b %Y %H:%M:%S GMT')) // 1000 - epoch_us(ts) // 1000 AS left_ FROM h),
w AS (SELECT *, CASE WHEN status = 429 THEN CASE WHEN seconds > 0 THEN seconds * 1000 WHEN left_ > 0 THEN left_ END END AS asked FROM a),
p AS (SELECT *, coalesce(status = 200 OR asked > 10000, false) AS last_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM w),
t AS (SELECT *, (p - 1 - coalesce(max(p) FILTER (WHERE last_) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 4 AS attempt FROM p),
o AS (SELECT *, p - attempt AS request, CASE WHEN status = 200 THEN 'done' WHEN attempt = 3 THEN 'failed' WHEN last_ THEN 'gave up' ELSE 'open' END AS outcome FROM t)
SELECT user_id, request, count(*) AS attempts, arg_max(outcome, p) AS outcome, coalesce(sum(CASE WHEN outcome = 'open' AND status = 429 THEN coalesce(asked, least(1000 * 2 ** attempt, 8000)::BIGINT) END), 0)::BIGINT AS waited_ms FROM o GROUP BY user_id, request""")
def z9_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all users out of the log of responses: their attempts, waits and ends; headers in seconds, as dates, and unreadable."""
    at, k = F.col("ts").cast("timestamp"), F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "click", 500).when(F.col("event_type") != "signup", 200)
    moment = F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(at) + (F.floor(k / 5) - 5) * 1_000_000), F.current_timezone())
    header = F.when(k % 5 == 0, F.concat(F.floor(k / 5).cast("string"), F.lit("s"))).when(k % 5 == 1, F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k % 5 == 2, "soon").when(k % 5 == 3, F.concat(F.lit("-"), k.cast("string")))
    log = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"), status.alias("status"), header.alias("retry_after"))
    return retries.requests(retries.attempts(log, "user_id", ["at", "event_id"]), "user_id")


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 2 = 0) AS store, arg_max(event_type, event_id) FILTER (WHERE event_id % 2 = 1 AND user_id % 3 > 0) AS cache FROM events GROUP BY user_id)
SELECT coalesce(store, 'error') <> 'error' AND coalesce(cache, 'view') <> 'error' AS healthy, count(*) AS n FROM l GROUP BY 1""")
def z13_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the latest probe of each service: the store is up, and the cache is up or there is none."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "store").when(F.col("user_id") % 3 > 0, "cache").alias("part"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("up"))
    return telemetry.health(e, "user_id").groupBy("healthy").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'purchase', 'error') THEN 'store' WHEN event_type = 'click' OR value > 40 THEN 'cache' ELSE 'other' END AS part, event_type NOT IN ('error', 'signup') AND value / 10 <= 5 AS up FROM events),
k AS (SELECT *, last_value(CASE WHEN part = 'store' THEN up END IGNORE NULLS) OVER w AS store, last_value(CASE WHEN part = 'cache' THEN up END IGNORE NULLS) OVER w AS cache FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, coalesce(store, false) AND coalesce(cache, true) AS after FROM k),
s AS (SELECT *, lag(after) OVER w AS before, lead(ts) OVER w AS until_ FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS probes, arg_max(after, (ts, event_id)) AS healthy, count_if(NOT after AND coalesce(before, true)) AS outages, coalesce(sum(CASE WHEN after THEN epoch_us(until_) - epoch_us(ts) END), 0)::BIGINT AS up_us, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM s GROUP BY user_id""")
def z13_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages and time in health of each user's service by all its probes in order of time; slow ones count as down."""
    kind = F.col("event_type")
    part = F.when(kind.isin("view", "purchase", "error"), "store").when((kind == "click") | (F.col("value") > 40), "cache").otherwise("other")
    probes = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), part.alias("part"), (~kind.isin("error", "signup")).alias("up"), (F.col("value") / 10).alias("took"))
    order = ["at", "event_id"]
    return telemetry.uptime(telemetry.health_changes(probes, "user_id", order), "user_id", "at", order)


@query()
def c1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite search: noisy requests, three sources, widening by track title; ranked editions."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    requests = part.select(
        k.alias("query_id"), F.concat(F.lit("01. "), "p_name", F.lit(", Book 2")).alias("title"), F.when(k % 2 == 0, F.col("p_brand")).alias("author"), F.when(k % 3 == 0, F.col("p_type")).alias("track"),
        F.when(k % 5 == 0, F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0"))).alias("asin"), F.lit(None).cast("string").alias("narrator"), (F.col("p_size") * 60_000).cast("long").alias("duration_ms"), F.lit("us").alias("region"),
    )
    offers = part.select(
        F.col("p_name").alias("block"), k.cast("string").alias("id"), F.when(k % 4 == 0, F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0"))).alias("asin"), F.concat("p_name", F.when(k % 9 == 0, F.lit(" Box Set")).otherwise(F.lit(""))).alias("title"),
        F.array("p_brand").alias("authors"), F.array().cast("array<string>").alias("narrators"), (F.col("p_size") * 60.0).alias("audio_seconds"), F.lit(None).cast("string").alias("cover"), F.when(k % 6 == 0, F.lit("german")).alias("language"), "p_size",
    )

    def source(name: str, rest: int) -> DataFrame:
        own = offers.filter(F.col("id").cast("long") % 3 == rest).withColumn("item_pos", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("p_size"), "id")) - 1).filter("item_pos < 5")
        want = part.select(k.alias("query_id"), F.col("p_name").alias("block"))
        return want.join(own, "block").drop("block", "p_size").withColumn("provider", F.lit(name))

    found = search.search(requests, [source("audible", 0), source("hardcover", 1)], [source("openlibrary", 2)])
    return found.select("query_id", "position", "provider", "id", F.round("confidence", 9).alias("confidence"), scoring.band(F.col("confidence")).alias("band"), "members")
