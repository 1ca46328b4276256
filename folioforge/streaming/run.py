"""Run a stream over what is there now and give its rows as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, table

#: State that outgrows memory and keeps timers: needed by transformWithState.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """The snapshot table as a file stream; `files`: at most so many to a batch."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/{name}*.parquet")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """All rows that the stream emits until it has read what is there; batch numbers the micro-batches."""
    spark = df.sparkSession
    path = shared_dir(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/part_={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{path}/rows").drop("part_")
