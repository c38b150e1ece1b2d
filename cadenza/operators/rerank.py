"""What the classifiers of playlists see of a track: its features, and how it stands to the playlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import key_distance, one_hot, weighted_cosine
from ..sources.domain import AUDIO
from .profile import mode_of

# The features by which tracks are compared, and the decades told apart.
SIMILARITY = [*AUDIO, "popularity", "top", "left", "fave_score", "n_playlists", "year_normalized"]
DECADES = [f"{year}s" for year in range(1950, 2030, 10)]
SIGNALS = ["similarity_score", "cluster_prob", "key_distance", "tempo_deviation", "embedding_similarity", "playlist_diversity"]


def number(c: str):
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def playlist_profiles(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(playlist_id, m_<feature>, modal_key, mean_tempo): the mean of its members' features (missing ones as 0), their commonest known key
    (ties to the first by name; '' without any) and their mean tempo. members: (playlist_id, track_id)."""
    held = members.select("playlist_id", "track_id").join(rows.select("track_id", "key_mode", *(number(c).alias(c) for c in SIMILARITY)), "track_id")
    means = held.groupBy("playlist_id").agg(*(F.avg(c).alias(f"m_{c}") for c in SIMILARITY), F.avg("tempo").alias("mean_tempo"))
    keys = mode_of(held.withColumn("key_mode", F.nullif(F.col("key_mode"), F.lit(""))), "playlist_id", "key_mode").select("playlist_id", F.col("key_mode").alias("modal_key"))
    return means.join(keys, "playlist_id", "left").withColumn("modal_key", F.coalesce("modal_key", F.lit("")))


def with_signals(pairs: DataFrame, rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """pairs (playlist_id, track_id and others) with the track's features and SIGNALS: the cosine with the playlist's mean track (0 for a
    playlist without a profile), the track's greatest cluster probability, the distance of its key from the playlist's, of its tempo
    from the mean tempo; embedding_similarity and playlist_diversity as far as rows has them, else 0."""
    held = [c for c in ("cluster_prob", "embedding_similarity", "playlist_diversity") if c in rows.columns]
    both = pairs.join(rows.select("track_id", "key_mode", "decade", "gen_4", *SIMILARITY, *held), "track_id").join(profiles, "playlist_id", "left")
    cosine = weighted_cosine([number(c) for c in SIMILARITY], [number(f"m_{c}") for c in SIMILARITY])
    made = {
        "similarity_score": cosine, "key_distance": key_distance(F.col("key_mode"), F.coalesce("modal_key", F.lit(""))).cast("double"), "tempo_deviation": F.abs(number("tempo") - number("mean_tempo")),
        **{c: number(c) if c in held else F.lit(0.0) for c in ("cluster_prob", "embedding_similarity", "playlist_diversity")},
    }
    return both.withColumns(made).drop(*(f"m_{c}" for c in SIMILARITY), "modal_key", "mean_tempo")


def names(genres: list[str]) -> list[str]:
    """The features in order: 15 of the track, 6 signals, its decade and its genre group one-hot."""
    return [*SIMILARITY, *SIGNALS, *(f"decade_{d}" for d in DECADES), *(f"gen_4_{g}" for g in genres)]


def vectors(signals: DataFrame, genres: list[str]) -> DataFrame:
    """signals, the rows of with_signals, and `features`, an array in the order of names(genres). Without similarity_score or
    cluster_prob it is an error; missing numbers count as 0, unknown decades and genres as none."""
    absent = [c for c in ("similarity_score", "cluster_prob") if c not in signals.columns]
    if absent:
        raise ValueError(f"columns needed for reranking: {', '.join(absent)}")
    numbers = F.array(*(number(c) if c in signals.columns else F.lit(0.0) for c in [*SIMILARITY, *SIGNALS]))
    return signals.withColumn("features", F.concat(numbers, one_hot(F.col("decade"), DECADES), one_hot(F.col("gen_4"), genres)))
