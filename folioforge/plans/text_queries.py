"""Queries of the text functions (N, X) on the snapshot tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..sources.tables import table
from . import sqltext as S
from .catalogue import query

_NOISY = {
    "suffix": ("concat(p_name, ', Book ', p_size)",) * 2,
    "track": ("concat('0', p_size % 10, ' ', p_name)",) * 2,
    "series": ("concat(p_name, ': Saga, Book ', p_size)",) * 2,
    "code": ("concat('GX', p_size, ' - ', p_name, ' (Unabridged)')",) * 2,
    "number": ("concat(p_size, ' - ', p_name, ' [Saga ', p_size, ']')",) * 2,
    "hash": ("concat(p_name, ' (Saga #', p_size, ')')",) * 2,
}


@query("SELECT form, title, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS form, {S.normalize_title(v[1])} AS title FROM part" for k, v in _NOISY.items()) + ") GROUP BY form, title")
def n1_normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    forms = F.array(*(F.struct(F.lit(k).alias("form"), F.expr(v[0]).alias("raw")) for k, v in _NOISY.items()))
    # Equal titles are normalised once.
    raw = part.select(F.explode(forms).alias("x")).groupBy("x.form", "x.raw").agg(F.count("*").alias("n"))
    return raw.groupBy("form", T.normalize_title(F.col("raw")).alias("title")).agg(F.sum("n").alias("n"))


@query("SELECT p_partkey, concat('B', lpad(p_partkey::VARCHAR, 9, '0')) AS asin, p_name AS title FROM part")
def n2_extract_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" [B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("]"))
    return table(spark, sf_dir, "part").select("p_partkey", T.bracketed_asin(raw).alias("asin"), T.without_edge_brackets(raw).alias("title"))


@query(f"SELECT lang, count(DISTINCT {S.clean('text')}) AS forms, sum(length({S.clean('text')}))::BIGINT AS chars FROM documents GROUP BY lang")
def n3_clean_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", T.clean(F.col("text")).alias("c")).groupBy("lang").agg(F.countDistinct("c").alias("forms"), F.sum(F.char_length("c")).alias("chars"))


@query(f"SELECT p_partkey, {S.base_title(chr(39).join(['concat(p_name, ', ': ', ', p_type, ', ' (x)', ')']))} AS base, {S.base_title(S._sub(chr(39).join(['concat(p_name, ', ' - ', ', p_type)']), r'(?s)[ ]+[-–—][ ]+.*'))} AS dashed FROM part")
def n5_base_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(": "), "p_type", F.lit(" (x)"))
    dash = F.concat("p_name", F.lit(" - "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.base_title(raw).alias("base"), T.base_title_dashed(dash).alias("dashed"))


@query("""
SELECT variant, count(*) AS n FROM (
  SELECT unnest(list_distinct([concat('The ', p_name, ' & ', p_type), concat(p_name, ' & ', p_type), concat('The ', p_name, ' and ', p_type), concat(p_name, ' and ', p_type)])) AS variant FROM part)
GROUP BY variant""")
def n7_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("The "), "p_name", F.lit(" & "), "p_type")
    return table(spark, sf_dir, "part").select(F.explode(T.title_variants(raw)).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"))


@query("""
SELECT s_suppkey, i AS pos, CASE i WHEN 0 THEN concat(s_name, ' & ', n_name) WHEN 1 THEN s_name ELSE n_name END AS author
FROM supplier JOIN nation ON s_nationkey = n_nationkey, range(0, 3) r(i)""")
def n9_split_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("s_suppkey", F.posexplode(T.split_authors(F.concat("s_name", F.lit(" & "), "n_name"))).alias("pos", "author")).withColumn("pos", F.col("pos").cast("long"))


@query("""
WITH v AS (SELECT p_name, regexp_extract(p_brand, '#(\\d+)', 1)::INT AS v, count(*) AS n FROM part GROUP BY ALL),
t AS (SELECT p_name, sum(n) AS titles, count(*) AS volumes, sum(n * n) AS same FROM v GROUP BY p_name)
SELECT p_name, volumes, ((titles * titles - same) / 2)::BIGINT AS conflicts FROM t""")
def n10_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes per title and how many pairs of its records conflict, from counts per volume: no pairs are made."""
    v = table(spark, sf_dir, "part").select("p_name", F.explode(T.volume_numbers(F.col("p_brand"))).alias("v")).groupBy("p_name", "v").agg(F.count("*").alias("n"))
    return v.groupBy("p_name").agg(F.count("*").alias("volumes"), ((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("conflicts"))


_NAME = "concat('Ann ', CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'B. ' ELSE concat(substr('CDEF', (c_custkey % 4 + 1)::INT, 1), '. ') END, 'Name', (c_custkey / 3)::BIGINT % 97)"


@query(f"""
WITH n AS (SELECT c_custkey, lower({_NAME.replace('(c_custkey / 3)::BIGINT', '(c_custkey // 3)')}) AS name FROM customer),
k AS (SELECT *, regexp_replace(name, '^(\\S+) (?:[a-z]\\.? )?(\\S+)$', '\\1 \\2') AS key, regexp_extract(name, '^\\S+ ([a-z])\\.? ', 1) AS sig FROM n)
SELECT key, count(*) AS n, count(DISTINCT sig) FILTER (WHERE sig <> '') AS signatures, CASE WHEN count(DISTINCT sig) FILTER (WHERE sig <> '') > 1 OR count(*) = 1 THEN count(*) ELSE 1 END AS kept FROM k GROUP BY key""")
def n13_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(_NAME.replace("(c_custkey / 3)::BIGINT", "(c_custkey div 3)").replace("(c_custkey % 4 + 1)::INT", "cast(c_custkey % 4 + 1 as int)"))
    n = table(spark, sf_dir, "customer").select(T.without_initials(name).alias("key"), F.nullif(T.initials(name), F.lit("")).alias("sig"))
    g = n.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("sig").alias("signatures"))
    return g.select("key", "n", "signatures", F.when((F.col("signatures") > 1) | (F.col("n") == 1), F.col("n")).otherwise(F.lit(1).cast("long")).alias("kept"))


@query("""
WITH w AS (SELECT p_partkey, str_split(concat(p_name, ' of the ', lower(p_type)), ' ') AS w FROM part)
SELECT p_partkey, list_aggregate(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND i < len(w) AND w[i] IN ('of', 'the') THEN w[i] ELSE concat(upper(w[i][1]), w[i][2:]) END), 'string_agg', ' ') AS title FROM w""")
def n14_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" of the "), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.title_case(raw).alias("title"))


@query("""
WITH r AS (SELECT l_linenumber, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'de' WHEN 'N' THEN 'us' ELSE 'fr' END AS region,
  CASE l_linenumber % 4 WHEN 0 THEN l_linenumber::VARCHAR WHEN 1 THEN concat('Chapter_', l_linenumber) WHEN 2 THEN concat('00', l_linenumber) ELSE concat('Part ', l_linenumber, '.') END AS raw FROM lineitem),
w AS (SELECT *, CASE region WHEN 'de' THEN 'Kapitel' WHEN 'fr' THEN 'Chapitre' ELSE 'Chapter' END AS word FROM r)
SELECT region, CASE l_linenumber % 4 WHEN 3 THEN concat('Part ', l_linenumber) ELSE concat(word, ' ', l_linenumber) END AS title, count(*) AS n FROM w GROUP BY ALL""")
def n15_chapter_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit("Chapter_"), n)).when(k == 2, F.concat(F.lit("00"), n)).otherwise(F.concat(F.lit("Part "), n, F.lit(".")))
    region = F.when(F.col("l_returnflag") == "A", "de").when(F.col("l_returnflag") == "N", "us").otherwise("fr")
    return table(spark, sf_dir, "lineitem").select(region.alias("region"), T.chapter_title(raw, L.chapter_word(region)).alias("title")).groupBy("region", "title").agg(F.count("*").alias("n"))


_CLEANED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\.[a-zA-Z0-9_-]+', '', 'g'), '(^|[^@A-Za-z0-9_])@[A-Za-z0-9_]{1,15}\b', '', 'g'), '(https?:\/\/)?[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+\.?(:\d+)?(\/\S*)?', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT lang, count(*) FILTER (WHERE c <> text) AS changed, sum(length(c))::BIGINT AS chars FROM (SELECT lang, text, {_CLEANED} AS c FROM documents) GROUP BY lang")
def n16_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "text", T.cleanup_description(F.col("text")).alias("c"))
    return d.groupBy("lang").agg(F.count_if(F.col("c") != F.col("text")).alias("changed"), F.sum(F.char_length("c")).alias("chars"))


@query(r"""
SELECT page_id, length(t)::INT AS chars FROM (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&amp;', '&', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def n18_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.char_length(T.strip_html(F.col("html"))), F.lit(0)).alias("chars"))


_PROVIDER = "CASE p_partkey % 6 WHEN 0 THEN 'audible' WHEN 1 THEN 'hardcover' WHEN 2 THEN 'openlibrary' WHEN 3 THEN 'storytel' WHEN 4 THEN 'apple' ELSE 'overdrive' END"
_KIND = "CASE p_partkey % 6 WHEN 1 THEN (CASE WHEN p_size % 2 = 0 THEN 'edition' ELSE 'book' END) WHEN 2 THEN 'works' WHEN 3 THEN 'book' WHEN 4 THEN 'audiobook' WHEN 5 THEN 'media' END"
_NATIVE = "CASE p_partkey % 6 WHEN 0 THEN concat('B', lpad(cast(p_partkey AS STRING), 9, '0')) WHEN 2 THEN concat('/works/OL', p_partkey, 'W') ELSE cast(p_partkey AS STRING) END"


@query(f"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN native WHEN 1 THEN concat('hardcover-', kind, '-', native) WHEN 2 THEN concat('openlibrary-works-', substr(native, 8)) WHEN 3 THEN concat('storytel-', native) WHEN 4 THEN concat('apple-audiobook-', native) ELSE concat('overdrive-', native) END AS encoded,
  CASE WHEN p_partkey % 6 > 0 THEN provider END AS provider, CASE WHEN p_partkey % 6 > 0 THEN kind END AS kind, CASE WHEN p_partkey % 6 > 0 THEN native END AS native
FROM (SELECT p_partkey, {_PROVIDER} AS provider, {_KIND} AS kind, {_NATIVE} AS native FROM part)""")
def n26_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select("p_partkey", T.encode_id(F.expr(_PROVIDER), F.expr(_KIND), F.expr(_NATIVE)).alias("encoded"))
    return ids.withColumn("d", T.decode_id(F.col("encoded"))).select("p_partkey", "encoded", "d.provider", "d.kind", "d.native")


_NOTATION = "CASE {k} WHEN 0 THEN lang WHEN 1 THEN CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' ELSE 'Espanol' END WHEN 2 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fra' ELSE 'spa' END WHEN 3 THEN concat(upper(lang), '-XX') WHEN 4 THEN CASE lang WHEN 'en' THEN 'British English' WHEN 'de' THEN 'Swiss German' WHEN 'fr' THEN 'Canadian French' ELSE 'Castilian Spanish' END ELSE 'klingon' END"
_REGION = "CASE n_nationkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'de' WHEN 2 THEN 'FR' ELSE 'es' END"


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 6 = 5 THEN NULL ELSE lang END AS code, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS want FROM documents)
SELECT code, want, count(*) AS n, count(*) FILTER (WHERE code IS NOT NULL AND code <> want) AS conflicts FROM d GROUP BY ALL""")
def n32_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notations of each document's language against the language of a region."""
    raw = F.expr(_NOTATION.format(k="doc_id % 6"))
    region = F.expr(_REGION.replace("n_nationkey", "doc_id"))
    d = table(spark, sf_dir, "documents").select(L.normalize_language(raw).alias("code"), L.region_language(region).alias("want"))
    return d.groupBy("code", "want").agg(F.count("*").alias("n"), F.count_if(L.languages_conflict(F.col("code"), F.col("want"))).alias("conflicts"))


@query("""
SELECT l_orderkey, l_linenumber, (h * 3600 + m * 60 + s)::BIGINT AS seconds, CASE WHEN h * 3600 + m * 60 + s > 0 THEN floor((h * 3600 + m * 60 + s) / 60.0 + 0.5)::BIGINT END AS minutes
FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS h, l_quantity::INT AS m, (l_partkey % 60)::INT AS s FROM lineitem)""")
def x7_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.records import duration_seconds

    text = F.format_string("%02d:%02d:%02d", F.col("l_linenumber"), F.col("l_quantity").cast("int"), (F.col("l_partkey") % 60).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", duration_seconds(text).alias("seconds")).withColumn("minutes", F.round(F.col("seconds") / 60).cast("long"))


@query("""
SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS top FROM events GROUP BY event_type""")
def x9_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that comes as a bare value or inside an object, read from either form."""
    from ..operators.records import text_or_field

    both = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_type", text_or_field(both, "k").cast("long").alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))
