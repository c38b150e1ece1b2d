from pyspark.sql import functions as F

from cadenza.operators import features
from cadenza.sources.domain import AUDIO, Library

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tracks_and_audio_of_one_pass(spark):
    """Kept together, both tables are what they are alone, from one pass over the items."""
    alone, lib = Library(spark, FOLDER), Library(spark, FOLDER)
    lib.tracks, lib.audio_features  # noqa: B018 a definition that is there already is made anew
    lib.keep("tracks", "audio_features", "track_artists")
    lib.keep("audio_features", "tracks")
    assert "_items" in lib.__dict__ and "lineitem" not in lib.audio_features._jdf.queryExecution().toString()
    close = lambda df: df.select(*(F.round(c, 5).alias(c) if c in AUDIO else F.col(c) for c in df.columns))
    assert lib.tracks.schema == alone.tracks.schema and rows(lib.tracks) == rows(alone.tracks)
    assert lib.audio_features.schema == alone.audio_features.schema and rows(close(lib.audio_features)) == rows(close(alone.audio_features))


def test_imputation_asks_only_for_gaps(spark):
    """Tracks with and without gaps, artists without values, and genres come out as by a plain loop."""
    cells = [(1, 1.0), (2, None), (3, 5.0), (4, None), (5, None)]
    profile = spark.createDataFrame([(t, g, v) for (t, v), g in zip(cells, ("a", "a", "b", "a", None), strict=True)], "track_id long, first_genre string, energy double")
    profile = profile.select("*", *(F.lit(0.5).alias(c) for c in AUDIO if c != "energy"), F.lit("spotify").alias("features_source"))
    artists = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 8), (4, 9), (5, 9)], "track_id long, artist_id long")
    got = {r["track_id"]: (r["energy"], r["features_source"]) for r in features.impute(profile, artists).collect()}
    assert got == {1: (1.0, "spotify"), 2: (1.0, "imputed_artist"), 3: (5.0, "spotify"), 4: (1.0, "imputed_genre"), 5: (3.0, "imputed_global")}
