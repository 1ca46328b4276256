"""Series of works: which work a title means, which series hold it, and its place in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import with_title_similarity
from ..functions.text import WB_L, WB_R, normalize_title, number_text
from ..sources.tables import cut_lineage
from .text_index import TextIndex

#: Title similarity from which a work is trusted, and how many hits are tried.
ACCEPT, DEPTH = 0.9, 3
#: Marks of series that are only an order, an edition or a universe.
VARIANT = rf"(?i){WB_L}(?:publication order|chronological|split[\s-]?volume|omnibus|box[\s-]?set|edition){WB_R}|{WB_L}[A-Za-z0-9_]*verse{WB_R}"


def accepted_works(hits: DataFrame) -> DataFrame:
    """query, work: of the first DEPTH hits (query, title, pos, work, forms) the first with a title form near enough."""
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).filter(F.col("_r") <= DEPTH).filter("work IS NOT NULL")
    pairs = first.select("query", "pos", "work", normalize_title(F.col("title")).alias("want"), F.explode(F.filter("forms", lambda f: F.length(f) > 0)).alias("form"))
    # A table, so that the patterns of titles and of their clean forms aren't compiled into one stage.
    pairs = cut_lineage(pairs.withColumn("form", normalize_title(F.col("form")))).filter("want != ''")
    near = with_title_similarity(pairs, "want", "form", "sim", least=ACCEPT).filter(F.col("sim") >= ACCEPT)
    return near.groupBy("query").agg(F.min_by("work", "pos").alias("work"))


def link_of(links: Column, work: Column) -> Column:
    """The link of a work in a series' links (work, text, number), else the only one there is."""
    own = F.get(F.filter(links, lambda x: x["work"] == work), F.lit(0))
    return F.coalesce(own, F.when(F.size(links) == 1, F.get(links, F.lit(0))))


def position_of(links: Column, work: Column) -> Column:
    """A work's place: the link's text unless blank or "0", else its number above zero, else null."""
    link = link_of(links, work)
    text = F.trim(link["text"])
    return F.coalesce(F.when((text != "") & (text != "0"), text), F.when(link["number"] > 0, number_text(link["number"])))


def ranked_series(series: DataFrame, sizes: DataFrame) -> DataFrame:
    """work, primary, secondary (name, position) of series rows (work, name, series, links, pos) and their sizes (series, members).

    Series that are only an order or an edition go where another stays; those
    with a place for the work come first, then the larger, then the earlier.
    """
    known = series.filter(F.length("name") > 0).join(sizes, "series", "left")
    rows = known.select("work", "pos", "name", F.coalesce("members", F.lit(0)).alias("members"), position_of(F.col("links"), F.col("work")).alias("position"), F.col("name").rlike(VARIANT).alias("variant"))
    order = F.struct("variant", F.col("position").isNull().alias("placeless"), (-F.col("members")).alias("fewer"), "pos", "name", "position")
    best = rows.groupBy("work").agg(F.array_sort(F.collect_list(order)).alias("s"))  # a work is in few series
    clean = F.filter("s", lambda x: ~x["variant"])
    pool = F.when(F.size(clean) > 0, clean).otherwise(F.col("s"))
    shaped = F.transform(pool, lambda x: F.struct(x["name"].alias("name"), x["position"].alias("position")))
    return best.select("work", F.get(shaped, F.lit(0)).alias("primary"), F.get(shaped, F.lit(1)).alias("secondary"))


def resolved(hits: DataFrame, series: DataFrame, sizes: DataFrame) -> DataFrame:
    """query, work, primary, secondary; a query whose hits can't be trusted, or whose work is in no series, has no row."""
    works = accepted_works(hits)
    return works.join(ranked_series(series.join(works.select("work").distinct(), "work", "left_semi"), sizes), "work").select("query", "work", "primary", "secondary")


def still_wanted(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys of df as a table behind a filter, from which Spark may build a bloom filter for what they are joined with."""
    return cut_lineage(df.select(key).distinct().withColumn("_wanted", F.lit(1))).filter("_wanted >= 1").select(key)


def chain(wanted: DataFrame, works: DataFrame, links: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """query, work, primary, secondary for every wanted title (query), from four snapshots; null where the chain breaks off.

    works: work, title.  links: series, work, text, number, pos.  names: series,
    name.  members: series, work.  Each snapshot is read for the keys that are
    still wanted only: accepted works, then the series that these are in, each of
    which is counted once however many works and queries lead to it.  The keys are
    kept as tables with the filter that made them, so that Spark can put a bloom
    filter of them on the scan of a large snapshot before anything is shuffled.
    """
    hits = TextIndex(works, "work", "title").search(wanted, DEPTH).select("query", F.col("query").alias("title"), "pos", F.col("key").alias("work"))
    hits = hits.join(works.select("work", F.array("title").alias("forms")), "work")
    accepted = cut_lineage(accepted_works(hits))
    found = cut_lineage(links.join(still_wanted(accepted, "work"), "work", "left_semi"))
    series_left = still_wanted(found, "series")
    named = names.join(series_left, "series", "left_semi")
    sizes = members.join(series_left, "series", "left_semi").groupBy("series").agg(F.countDistinct("work").alias("members"))
    own = found.groupBy("work", "series").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("work", "text", "number"))).alias("links"))
    ranked = ranked_series(own.join(named, "series"), sizes)
    return wanted.select("query").distinct().join(accepted, "query", "left").join(ranked, "work", "left").select("query", "work", "primary", "secondary")
