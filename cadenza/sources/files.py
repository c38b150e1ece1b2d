"""Files in and out: play history, tables with other columns in each file, payloads, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "ts string, ms_played long, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string, skipped boolean"
# Names of the history's columns, and what stands for a missing value in a CSV file.
NAMES = {"master_metadata_track_name": "track_name", "master_metadata_album_artist_name": "artist_name", "master_metadata_album_album_name": "album_name"}
MISSING = ["", "NA", "NaN"]


def play_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON files, each with one object or an array of them (with `lines`, an object a line); missing names '', times 0, skipped false."""
    rows = spark.read.schema(HISTORY).option("multiLine", not lines).option("pathGlobFilter", "*.json").json(path).withColumnsRenamed(NAMES)
    return rows.fillna("", list(NAMES.values())).fillna({"ms_played": 0, "skipped": False})


def csv_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with a header each, put together by column name; columns that a file lacks, and marks of missing values, are null."""
    out = None
    for path in paths:
        one = spark.read.option("header", True).csv(path)
        one = one.select(*(F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in one.columns))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no CSV files")
    return out


def payload_tracks(payloads: DataFrame, items: str = "items") -> DataFrame:
    """Track rows of API payloads (items: array of structs with a track); entries without a track or its id are left out."""
    t = payloads.select(F.explode(items).alias("i")).select("i.track.*").filter("id is not null")
    pick = lambda field: F.transform("artists", lambda a: a[field])
    return t.select(F.col("id").alias("track_id"), F.col("name").alias("track_name"), pick("id").alias("artist_ids"), pick("name").alias("artist_names"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON lines, doubles to four places, one folder for each kind of row (kind: 'model' or 'summary')."""
    rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*rounded).write.mode("overwrite").partitionBy("kind").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).withColumn("file", F.input_file_name())
