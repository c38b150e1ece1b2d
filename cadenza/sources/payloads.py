"""Landed payloads of web services, and wide exports, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import list_items

# Audio fields of a feature payload and what a missing one counts as; least count of a tag.
FEATURE_DEFAULTS = {
    "danceability": 0.0,
    "energy": 0.0,
    "loudness": 0.0,
    "tempo": 0.0,
    "time_signature": 4.0,
}
LEAST_TAG_COUNT = 5


def feature_rows(payloads: DataFrame) -> DataFrame:
    """Rows of audio-feature payloads (audio_features: array of structs); entries that are null, or without an id, are left out."""
    entry = payloads.select(F.explode("audio_features").alias("f")).filter("f.id is not null")
    return entry.select(F.col("f.id").alias("track_id"), *(F.coalesce(F.col(f"f.{c}").cast("double"), F.lit(v)).alias(c) for c, v in FEATURE_DEFAULTS.items()))


def artist_rows(payloads: DataFrame, genres: int = 3) -> DataFrame:
    """Rows of artist payloads (artists: array of structs with id, name, genres, followers.total): the first few genres, followers 0
    where missing."""
    a = payloads.select(F.explode("artists").alias("a")).filter("a.id is not null")
    return a.select(F.col("a.id").alias("artist_id"), F.col("a.name").alias("artist_name"), F.slice(F.coalesce("a.genres", F.array().cast("array<string>")), 1, genres).alias("genres"), F.coalesce("a.followers.total", F.lit(0).cast("long")).alias("followers"))


def album_rows(payloads: DataFrame) -> DataFrame:
    a = payloads.select(F.explode("items").alias("a"))
    return a.select(F.col("a.id").alias("album_id"), F.col("a.name").alias("album_name"), F.col("a.release_date").alias("release_date"), F.col("a.total_tracks").alias("total_tracks"))


def tags_of(payload: Column) -> Column:
    """Names of the tags in a payload's text, where `tag` is one object or an array of them: lower case, in order, of
    LEAST_TAG_COUNT uses or more."""
    one = "struct<name:string,count:bigint>"
    many = F.from_json(payload, f"tag array<{one}>")["tag"]
    single = F.from_json(payload, f"tag {one}")["tag"]
    tags = F.coalesce(many, F.when(single["name"].isNotNull(), F.array(single)), F.array().cast(f"array<{one}>"))
    return F.transform(F.filter(tags, lambda t: t["count"] >= LEAST_TAG_COUNT), lambda t: F.lower(t["name"]))


def typed_csv(spark: SparkSession, path: str, types: dict[str, str], rename: dict[str, str], missing: list[str]) -> DataFrame:
    """A CSV with a header: its marks of missing values are null, the columns of `types` (all that are kept) are cast, others that
    don't parse are null, names are changed as told, repeated rows go."""
    raw = spark.read.option("header", True).csv(path)
    held = lambda c: F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`"))
    return raw.select(*(held(c).try_cast(t).alias(rename.get(c, c)) for c, t in types.items())).distinct()


def normalised(wide: DataFrame) -> dict[str, DataFrame]:
    """A wide export (a row for each playlist and track, artists as a list in text) as five tables."""
    artists = F.posexplode(list_items(F.col("artist_ids"))).alias("place", "artist_id")
    names = wide.select(F.posexplode(F.arrays_zip(list_items(F.col("artist_ids")).alias("id"), list_items(F.col("artist_names")).alias("name"))).alias("place", "a"))
    return {
        "tracks": wide.select("track_id", "track_name", "popularity").dropDuplicates(["track_id"]),
        "audio_features": wide.filter("tempo is not null").select("track_id", "tempo", "energy").dropDuplicates(["track_id"]),
        "playlist_tracks": wide.select("playlist_id", "track_id").distinct(),
        "track_artists": wide.select("track_id", artists).select("track_id", "artist_id").distinct(),
        "artists": names.select(F.col("a.id").alias("artist_id"), F.col("a.name").alias("artist_name")).groupBy("artist_id").agg(F.min("artist_name").alias("artist_name")),
    }


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at `path`; where there is none yet, make() is written there first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)


def first_source(makes: list) -> DataFrame:
    """The first of several sources that has rows; sources that can't be read count as empty. None: an error."""
    from pyspark.errors import AnalysisException

    for make in makes:
        try:
            found = make()
            if not found.isEmpty():
                return found
        except AnalysisException:
            continue
    raise ValueError("no source has rows")


# What a playlist's status may be; any other one counts as the last.
STATUSES = ["active", "archived", "excluded"]


def with_status(playlists: DataFrame, config: dict[str, str], key: str) -> DataFrame:
    """playlists and their status by a configuration of a few names; names that it lacks, and statuses that are none, are excluded."""
    spark = playlists.sparkSession
    known = spark.createDataFrame([(k, v) for k, v in config.items() if v in STATUSES] or [("", STATUSES[-1])], f"{key} string, status string")
    return playlists.join(F.broadcast(known), key, "left").withColumn("status", F.coalesce("status", F.lit(STATUSES[-1])))
