"""The feature matrix: imputation with its source, collaborative and temporal features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.domain import AUDIO
from .quantiles import medians
from .storage import cut


def impute(profile: DataFrame, track_artists: DataFrame) -> DataFrame:
    """Fills missing audio features by the medians of the track's artists (least artist id first), then of its genre, then of all,
    and says in features_source which level came last into play. Medians come from rows with source 'spotify'."""
    real = profile.filter("features_source = 'spotify'")
    most = track_artists.count(), profile.count()
    artist = medians(real.select("track_id", *AUDIO).join(track_artists, "track_id"), AUDIO, ["artist_id"], most=most[0])
    anything = lambda test: reduce(lambda a, b: a | b, (test(c) for c in AUDIO))
    gap = anything(lambda c: F.col(c).isNull())
    asked = track_artists.join(profile.filter(gap).select("track_id"), "track_id", "left_semi")  # a track without gaps takes nothing
    by_artist = asked.join(artist, "artist_id").groupBy("track_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("artist_id"))).alias(f"a_{c}") for c in AUDIO))
    # a track counts for its genre, if it has one, and for all
    every = F.lit(None).cast(profile.schema["first_genre"].dataType)
    levels = F.explode(F.when(F.col("first_genre").isNull(), F.array(every)).otherwise(F.array(every, "first_genre"))).alias("level")
    by_level = cut(medians(real.select(levels, *AUDIO), AUDIO, ["level"], most=2 * most[1]))
    genre = by_level.filter("level is not null").select(F.col("level").alias("first_genre"), *(F.col(c).alias(f"g_{c}") for c in AUDIO), F.lit(True).alias("g_any"))
    overall = by_level.filter("level is null").agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(f"o_{c}") for c in AUDIO)).withColumn("one", F.lit(1))
    rows = profile.withColumn("one", F.lit(1)).join(by_artist, "track_id", "left").join(F.broadcast(genre), "first_genre", "left").join(F.broadcast(overall), "one")
    by_a = anything(lambda c: F.col(c).isNull() & F.col(f"a_{c}").isNotNull())
    left_a = anything(lambda c: F.coalesce(c, f"a_{c}").isNull())
    left_g = anything(lambda c: F.coalesce(c, f"a_{c}", f"g_{c}").isNull())
    source = F.when(~gap, F.col("features_source")).when(by_a, "imputed_artist").when(left_a & F.col("g_any"), "imputed_genre").when(left_g, "imputed_global").otherwise(F.col("features_source"))
    filled = [F.coalesce(c, f"a_{c}", f"g_{c}", f"o_{c}").alias(c) for c in AUDIO]
    return rows.select(*(c for c in profile.columns if c not in [*AUDIO, "features_source"]), *filled, source.alias("features_source"))


def overall_medians(rows: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """One row: the columns' medians, 0 where a column has no values or there are no rows."""
    found = medians(rows, columns, most=most)
    return found.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in columns))


def collaborative(profile: DataFrame, playlist_tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """n_playlists and playlist_diversity (different labels of the playlists a track is on). labels: (playlist_id, label)."""
    n = playlist_tracks.groupBy("track_id").agg(F.count("*").cast("double").alias("n_playlists"))
    kinds = playlist_tracks.join(labels, "playlist_id").groupBy("track_id").agg(F.countDistinct("label").cast("double").alias("playlist_diversity"))
    out = profile.join(n, "track_id", "left").join(kinds, "track_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("n_playlists", "playlist_diversity")})


def temporal(df: DataFrame, as_of_year: int) -> DataFrame:
    """year_normalized and duration_ms_normalized (0..1, missing 0.5; a constant column has range 1), years_since_release (missing: median)."""
    bounds = df.agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min("duration_ms").alias("d0"), F.max("duration_ms").alias("d1")).withColumn("one", F.lit(1))
    middle = overall_medians(df.select((as_of_year - F.col("year")).alias("mid")).filter("mid is not null"), ["mid"]).withColumn("one", F.lit(1))
    rows = df.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one").join(F.broadcast(middle), "one")
    scaled = lambda c, a, b: F.coalesce((F.col(c) - F.col(a)) / F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1), F.lit(0.5))
    new = {"year_normalized": scaled("year", "y0", "y1"), "duration_ms_normalized": scaled("duration_ms", "d0", "d1"), "years_since_release": F.coalesce((as_of_year - F.col("year")).cast("double"), "mid")}
    return rows.withColumns(new).select(*df.columns, *new)


def playlist_neighbourhood(members: DataFrame, audio: DataFrame, columns: list[str]) -> DataFrame:
    """pp_*: the mean over a track's playlists of their mean features, the track itself included; tracks on no playlist have no row."""
    means = members.join(audio, "track_id").groupBy("playlist_id").agg(*(F.avg(c).alias(f"pp_{c}") for c in columns))
    return members.join(means, "playlist_id").groupBy("track_id").agg(*(F.avg(f"pp_{c}").alias(f"pp_{c}") for c in columns))
