"""The feature matrix in its order of steps, and the vectors that clustering and reranking take from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import min_max, one_hot
from ..sources.domain import AUDIO, KEYS
from . import features
from .storage import cut

UNKNOWN = "_unknown_"


def feature_matrix(profile: DataFrame, track_artists: DataFrame, playlist_tracks: DataFrame, labels: DataFrame, members: DataFrame, audio: DataFrame, coordinates: DataFrame, vectors: DataFrame, as_of_year: int, size: int) -> DataFrame:
    """One row a track: collaborative and temporal features, artist coordinates, imputed audio features, the embedding (zeros where
    there is none) and the playlists' profile. popularity and pp_* stay null where they are missing."""
    rows = features.collaborative(profile, playlist_tracks, labels)
    rows = features.temporal(cut(rows), as_of_year)
    rows = rows.drop("top", "left").join(coordinates.select("track_id", "top", "left"), "track_id", "left")
    rows = features.impute(cut(rows), track_artists)
    rows = rows.join(vectors.select("track_id", "vector"), "track_id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)))
    rows = rows.join(features.playlist_neighbourhood(members, audio, AUDIO), "track_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("top", "left", "fave_score")})


def cluster_vectors(rows: DataFrame, columns: list[str], category: str, vocabulary: list[str]) -> DataFrame:
    """track_id and vector: the columns scaled to 0..1 (missing ones as 0, before scaling), then the category one-hot."""
    filled = rows.select("track_id", category, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    bounds = filled.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns)).withColumn("one", F.lit(1))
    both = filled.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one")
    scaled = F.array(*(min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns))
    return both.select("track_id", F.concat(scaled, one_hot(F.col(category), vocabulary)).alias("vector"))


# The features that mixtures are fitted on, and the keys that are told apart.
CLUSTER_FEATURES = [*AUDIO, "top", "left", "fave_score", "n_playlists", "year_normalized", "duration_ms_normalized"]
KEY_MODES = [f"{k} {m}" for m in ("Minor", "Major") for k in KEYS]


def mixture_vectors(rows: DataFrame, decades: list[str]) -> DataFrame:
    """track_id and vector of 47: CLUSTER_FEATURES (missing ones as 0), key_mode and decade one-hot, each column scaled to 0..1 over all
    rows (a constant one gives 0)."""
    number = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CLUSTER_FEATURES))
    raw = rows.select("track_id", F.concat(number, one_hot(F.col("key_mode"), KEY_MODES), one_hot(F.col("decade"), decades)).alias("x"))
    n = len(CLUSTER_FEATURES) + len(KEY_MODES) + len(decades)
    ends = raw.agg(F.array(*(F.min(F.col("x")[i]) for i in range(n))).alias("lo"), F.array(*(F.max(F.col("x")[i]) for i in range(n))).alias("hi")).withColumn("one", F.lit(1))
    both = raw.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one")
    scaled = F.transform("x", lambda v, i: min_max(v, F.get("lo", i), F.get("hi", i)))
    return both.select("track_id", scaled.alias("vector"))


def rerank_vectors(rows: DataFrame, needed: list[str], optional: list[str]) -> DataFrame:
    """track_id and vector of needed and optional columns. A needed column that is absent is an error, an optional one counts as 0."""
    absent = [c for c in needed if c not in rows.columns]
    if absent:
        raise ValueError(f"columns needed for reranking: {', '.join(absent)}")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    keys = [c for c in ("request_id", "playlist_id", "track_id") if c in rows.columns]
    return rows.select(*keys, F.array(*map(value, [*needed, *optional])).alias("vector"))


def categories(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(UNKNOWN)) for c in columns})


def retrieval_signals(rows: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """(playlist_id, track_id, similarity): the cosine of each member with the mean of its playlist's members, within 0..1; for all
    playlists at once. Missing values count as 0, a vector without length gives 0."""
    held = members.join(rows.select("track_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)), "track_id")
    centres = held.groupBy("playlist_id").agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    both = held.join(centres, "playlist_id")
    dot = lambda a, b: sum((F.col(x) * F.col(y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    m = [f"m_{c}" for c in columns]
    norm = F.sqrt(dot(columns, columns)) * F.sqrt(dot(m, m))
    return both.select("playlist_id", "track_id", F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(columns, m) / norm))).otherwise(0.0).alias("similarity"))
