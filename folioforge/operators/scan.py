"""Running values within a key, however many rows a key has.

Rows are sorted by key and order into ranges, one to a partition, so a hot key
lies in several.  A running value is that within the range, and what the ranges
before it carry in: one row for each range and key.  No window is over a whole
key, and no task has more than one range of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage


class Ranges:
    """df in ranges of (key, order); `order` are columns of df, ascending, and should tell all rows of a key apart."""

    def __init__(self, df: DataFrame, key: str, order: list[str]):
        self.key, self.order = key, order
        # The ranges are sampled, so they are kept as a table.
        self.rows = cut_lineage(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
        self.within = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        self.before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def _with(self, df: DataFrame, carried: DataFrame) -> DataFrame:
        same = F.col(self.key).eqNullSafe(F.col("_carried")) & (F.col("_range") == F.col("_into"))
        return df.join(carried.withColumnsRenamed({self.key: "_carried", "_range": "_into"}), same).drop("_carried", "_into")

    def running_sum(self, value: Column, out: str) -> DataFrame:
        """The rows with the sum of `value` over those of the key up to each."""
        rows = self.rows.withColumn("_value", value)
        carried = rows.groupBy("_range", self.key).agg(F.sum("_value").alias("_sofar"))
        carried = carried.select("_range", self.key, F.coalesce(F.sum("_sofar").over(self.before), F.lit(0)).alias("_sofar"))
        return self._with(rows.withColumn(out, F.sum("_value").over(self.within)), carried).withColumn(out, F.coalesce(out, F.lit(0)) + F.col("_sofar")).drop("_value", "_sofar", "_range")

    def last_known(self, value: Column, out: str) -> DataFrame:
        """The rows with the last value that isn't null of those of the key up to each."""
        return self.last_values({out: value})

    def last_values(self, values: dict[str, Column], own: bool = True) -> DataFrame:
        """The rows with the last value that isn't null, by name, of those of the key up to each; without `own`, of those before it."""
        rows = self.rows.withColumns({f"_value_{k}": v for k, v in values.items()})
        newest = lambda k: F.max_by(f"_value_{k}", F.when(F.col(f"_value_{k}").isNotNull(), F.struct(*self.order)))
        carried = rows.groupBy("_range", self.key).agg(*(newest(k).alias(f"_sofar_{k}") for k in values))
        carried = carried.select("_range", self.key, *(F.last(f"_sofar_{k}", ignorenulls=True).over(self.before).alias(f"_sofar_{k}") for k in values))
        within = self.within if own else self.within.rowsBetween(Window.unboundedPreceding, -1)
        known = self._with(rows.withColumns({k: F.last(f"_value_{k}", ignorenulls=True).over(within) for k in values}), carried)
        return known.withColumns({k: F.coalesce(k, f"_sofar_{k}") for k in values}).drop(*(f"_{x}_{k}" for k in values for x in ("value", "sofar")), "_range")

    def runs(self, ends: Column, run: str, place: str) -> DataFrame:
        """The rows with the run that they are in and their place in it, from 1; a row for which `ends` holds is the last of its run.

        A run's number is the place of its first row within the key.
        """
        here = Window.partitionBy("_range", self.key).orderBy(*self.order)
        rows = self.rows.withColumn("_ends", F.coalesce(ends, F.lit(False))).withColumn("_n", F.row_number().over(here).cast("long"))
        ended = F.max(F.when(F.col("_ends"), F.col("_n")))
        carried = rows.groupBy("_range", self.key).agg(F.count("*").alias("_rows"), ended.alias("_last"))
        carried = carried.withColumn("_ahead", F.coalesce(F.sum("_rows").over(self.before), F.lit(0)))
        carried = carried.select("_range", self.key, "_ahead", F.max(F.col("_last") + F.col("_ahead")).over(self.before).alias("_since"))
        rows = rows.withColumn("_last", ended.over(here.rowsBetween(Window.unboundedPreceding, -1)))
        out = self._with(rows, carried).withColumn(run, F.coalesce(F.col("_last") + F.col("_ahead"), "_since", F.lit(0)) + 1)
        return out.withColumn(place, F.col("_n") + F.col("_ahead") - F.col(run) + 1).drop("_ends", "_n", "_last", "_ahead", "_since", "_range")

    def numbered(self, out: str) -> DataFrame:
        """The rows with their place within the key, from 1."""
        return self.running_sum(F.lit(1).cast("long"), out)


def most_open(jobs: DataFrame, key: str, start: str, end: str, out: str = "most_open") -> DataFrame:
    """key, how many of its jobs (from start to end, the end not included) were open at once at most."""
    mark = lambda at, d: F.struct(F.col(at).alias("at"), F.lit(d).alias("d"))
    marks = jobs.select(key, F.explode(F.array(mark(start, 1), mark(end, -1))).alias("m")).select(key, "m.at", "m.d")
    # Marks of one moment come ends first; equal ones are one row, so ranges never part them.
    summed = marks.groupBy(key, "at", "d").agg(F.sum("d").cast("long").alias("n"))
    return Ranges(summed, key, ["at", "d"]).running_sum(F.col("n"), "open").groupBy(key).agg(F.max("open").alias(out))
