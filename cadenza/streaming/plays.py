"""Play events as streams: ingest without repeats, and counts by day. Each run takes what has arrived and ends (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LATE = "1 day"


def read(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob).load(folder)


def ingest(events: DataFrame, out: str, checkpoint: str, key: str = "event_id", time: str = "ts") -> None:
    """Appends events to Parquet, each key once within the watermark; rows without a time can't be placed and are left out."""
    stream = events.filter(F.col(time).isNotNull()).withWatermark(time, LATE).dropDuplicatesWithinWatermark([key])
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()


def daily_counts(events: DataFrame, out: str, checkpoint: str, by: str, time: str = "ts") -> None:
    """Plays by day and item. Each batch writes the counts that it changed under its own number, so that a batch that is run again
    replaces its own rows; latest() reads the newest count of each."""
    counts = events.filter(F.col(time).isNotNull()).withWatermark(time, LATE).groupBy(F.window(time, "1 day").alias("w"), by).agg(F.count("*").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("date").alias("day"), by, "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, by: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("day", by).agg(F.max_by("n", "batch").alias("n"))


def upsert_members(events: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """The latest event (by event_id) of each key. Each batch writes its own rows under its number, so that a batch that is run again
    replaces them and nothing else; latest_members() reads the newest of each key."""

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_members(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by("event_type", "event_id").alias("event_type"))
