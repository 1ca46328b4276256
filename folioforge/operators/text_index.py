"""Inverted index of short texts, and the best records for each query by it.

A text's terms are its runs of letters and digits, lower-cased.  The index holds
postings (term, text, impact) with each term's document frequency; equal texts
are indexed once.  A term's impact on a text is 1 (score: how many of the query's
terms it shares) or, weighted, grows with the term's share of the text:
(1/2 + 1/2 * tf / length) * (2 - 2 ** (1 - tf)), in millionths.

A term in more than `common` texts is common.  Its postings never meet a query's
text by text:

- Texts that share a rare term with a query are candidates; there are at most
  `common` of them for each term.  They are scored whole, common terms included.
- Texts that share common terms only are judged by class: a class is a set of
  common terms that queries have, with their impacts, and its texts score alike,
  so of each class the first `most` texts do.  The best `most` of these are found
  once for each set of common terms that a query has, whatever number has it.

The best `most` of both are the best of all: what is left out has `most` texts
before it.  So work grows with the postings, not with the square of a word's
texts; what is left of squares are sets and classes that share a common term
which isn't ruled out by impacts (see _best_of_classes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

COMMON, MOST = 128, 25
#: Parts of a common term's classes, so that a term's sets and classes don't meet in one task.
SLOTS = 16


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _first(df: DataFrame, within: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group; Spark cuts each task's part down before it is dealt."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def _shared() -> Column:
    """Sum of a profile's impacts on the terms of `wanted`."""
    return F.aggregate(F.filter("profile", lambda x: F.array_contains("wanted", x["term"])), F.lit(0).cast("long"), lambda total, x: total + x["impact"])


class TextIndex:
    """records: key and text; a null text or one without terms is in no posting."""

    def __init__(self, records: DataFrame, key: str, text: str, weighted: bool = False, common: int = COMMON):
        self.records = records.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        names = cut_lineage(self.records.groupBy("_text").agg(F.min("_key").alias("name")).filter("_text IS NOT NULL"))
        own = names.select("name", terms(F.col("_text")).alias("w")).select("name", F.size("w").alias("length"), F.explode("w").alias("term"))
        counted = own.groupBy("name", "length", "term").agg(F.count("*").alias("tf"))
        impact = F.floor(F.lit(1e6) * (F.lit(0.5) + F.lit(0.5) * F.col("tf") / F.col("length")) * (F.lit(2.0) - F.pow(F.lit(2.0), 1 - F.col("tf")))) if weighted else F.lit(1)
        posted = cut_lineage(counted.select("term", "name", impact.cast("long").alias("impact")))
        frequency = posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("common", F.col("df") > common)
        self.names = names
        self.frequency = cut_lineage(frequency)
        self.postings = cut_lineage(posted.join(self.frequency.select("term", "common"), "term").sortWithinPartitions("term"))

    def _profiles(self, asked: DataFrame) -> DataFrame:
        """name, profile: the common terms of each text that queries have and it has, with their impacts; the rarest first.

        What no query asks for makes no difference to a score, so it makes no classes either.
        """
        wanted = asked.filter("common").select("term").distinct()
        kept = self.postings.filter("common").join(self.frequency.select("term", "df").join(wanted, "term"), "term")
        return kept.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "term", "impact"))).alias("profile"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query, term, common: the distinct known terms of each distinct query."""
        own = queries.select("query").filter("query IS NOT NULL").distinct()
        own = own.select("query", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
        return own.join(self.frequency.select("term", "common"), "term")

    def candidates(self, queries: DataFrame, most: int = MOST) -> DataFrame:
        """query, name, score: texts among which are the best `most` of each query, all that share a rare term scored whole."""
        asked = cut_lineage(self._asked(queries))
        profiles = cut_lineage(self._profiles(asked))
        rare = asked.filter("NOT common").join(self.postings.filter("NOT common").select("term", "name", "impact"), "term").groupBy("query", "name").agg(F.sum("impact").alias("rare"))
        wanted = cut_lineage(asked.filter("common").groupBy("query").agg(F.array_sort(F.collect_list("term")).alias("wanted")))
        both = rare.join(wanted, "query", "left").join(profiles, "name", "left")
        shared = _shared()
        met = both.select("query", "name", (F.col("rare") + F.coalesce(shared, F.lit(0))).alias("score"))
        best = self._best_of_classes(wanted, profiles, most)
        alike = wanted.join(best, "wanted").select("query", "name", "score")
        return met.unionByName(alike).groupBy("query", "name").agg(F.max("score").alias("score"))

    def _best_of_classes(self, wanted: DataFrame, profiles: DataFrame, most: int) -> DataFrame:
        """wanted, name, score: the best `most` texts for each set of common terms that is asked for, by these terms alone.

        Classes are met by a set's rarest term first.  The score of the last of
        the best `most` texts so found is a floor: of the set's further terms, in
        order of rarity, only those are opened from which on the greatest impacts
        together reach it, as a text with none but later terms stays below.  Of
        what is opened a set meets the classes that have none of its rarer terms
        (so each but once), whose own impacts from that term on reach the floor.
        Scores are taken where a term's sets and classes meet, in SLOTS parts of
        its classes, and those below the floor go no further.
        """
        heads = cut_lineage(_first(profiles, ["profile"], [F.col("name")], most).withColumn("class", F.min("name").over(Window.partitionBy("profile"))))
        own = heads.filter("name = class").select("class", F.pmod(F.hash("class"), F.lit(SLOTS)).alias("slot"), "profile", F.posexplode("profile").alias("i", "x"))
        rarer = F.transform(F.slice("profile", 1, F.col("i")), lambda x: x["term"])
        cap = F.aggregate(F.slice("profile", F.col("i") + 1, F.size("profile")), F.lit(0).cast("long"), lambda total, x: total + x["impact"])
        opened = cut_lineage(own.select("class", "slot", F.col("x.term").alias("term"), rarer.alias("rarer"), cap.alias("cap"), "profile"))
        limits = self.postings.filter("common").groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most_impact"))
        sets = cut_lineage(wanted.select("wanted").distinct().withColumn("set", F.monotonically_increasing_id()))
        terms_ = sets.select("set", F.explode("wanted").alias("term")).join(limits, "term").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("df", "term", "most_impact"))).alias("terms"))
        terms_ = cut_lineage(terms_)

        parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Sets and classes are small and what they meet is not, so both are dealt by number, whatever their size.
        deal = lambda df: df.repartition(parts, "term", "slot")

        def scored(asking: DataFrame) -> DataFrame:
            """set, class, score: what sets meet by a term (set, term, floor) and isn't below their floor."""
            dealt = asking.join(sets, "set").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
            both = deal(dealt).join(deal(opened), ["term", "slot"]).filter((F.col("cap") >= F.col("floor")) & ~F.arrays_overlap("wanted", "rarer"))
            return both.select("set", "class", _shared().alias("score"), "floor").filter(F.col("score") >= F.col("floor")).drop("floor")

        def texts(found: DataFrame) -> DataFrame:
            """set, name, score of the best `most` texts of scored classes."""
            top = _first(found, ["set"], [F.desc("score"), F.col("class")], most).join(heads.select("class", "name"), "class")
            return _first(top, ["set"], [F.desc("score"), F.col("name")], most).select("set", "name", "score")

        first = cut_lineage(texts(scored(terms_.select("set", F.get("terms", F.lit(0))["term"].alias("term"), F.lit(0).cast("long").alias("floor")))))
        floor = first.groupBy("set").agg(F.when(F.count("*") >= most, F.min("score")).otherwise(0).alias("floor"))
        rest = lambda t, i: F.aggregate(F.slice(t, i + 1, F.size(t)), F.lit(0).cast("long"), lambda total, x: total + x["most_impact"])
        reaching = F.filter(F.transform("terms", lambda x, i: F.when((i > 0) & (rest(F.col("terms"), i) >= F.col("floor")), x["term"])), lambda x: x.isNotNull())
        more = texts(scored(terms_.join(floor, "set").select("set", F.explode(reaching).alias("term"), "floor")))
        return _first(first.unionByName(more), ["set"], [F.desc("score"), F.col("name")], most).join(sets, "set").select("wanted", "name", "score")

    def search(self, queries: DataFrame, most: int = MOST) -> DataFrame:
        """query, key, score, pos: the `most` best records of each distinct query (column query), the lesser key of equals first."""
        best = _first(self.candidates(queries, most), ["query"], [F.desc("score"), F.col("name")], most)
        few = _first(self.records.filter("_text IS NOT NULL"), ["_text"], [F.col("_key")], most)
        keyed = few.join(self.names, "_text").select("name", F.col("_key").alias("key"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
        return best.join(keyed, "name").withColumn("pos", place).filter(F.col("pos") <= most).select("query", "key", "score", F.col("pos").cast("long").alias("pos"))
