"""Registered queries that run the streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import new_folder
from ..streaming import plays
from .registry import query


def _scratch(lib) -> str:
    return new_folder(lib.spark, "stream")


def _events(lib):
    schema = lib.table("events").schema
    return plays.read(lib.spark, lib.folder, schema, "events.parquet")


@query("n04_ingest", "select event_id, user_id, event_type, value from events")
def _(lib):
    folder = _scratch(lib)
    events = _events(lib).withColumn("ts", F.col("ts").cast("timestamp"))
    plays.ingest(events.unionByName(events.filter("event_id % 10 = 0")), f"{folder}/out", f"{folder}/state")
    return lib.spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type", "value")


@query("n06_daily_counts", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2")
def _(lib):
    folder = _scratch(lib)
    plays.daily_counts(_events(lib).withColumn("ts", F.col("ts").cast("timestamp")), f"{folder}/out", f"{folder}/state", "event_type")
    return plays.latest(lib.spark, f"{folder}/out", "event_type").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")
