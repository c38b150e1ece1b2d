"""Registered queries on sources, the feature matrix, genre matching, neighbours, and orders of steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters, genres, learners, matrix, merge, profile, recommend, retrieval
from ..operators.storage import new_folder
from ..sources import files, payloads
from ..sources.domain import AUDIO
from ..streaming import plays
from .models import _CENTRES, _PROBS, _corpus, _probs, _vectors
from .registry import _IMPUTED, _PROFILE_SQL, _SCORED, _SQL, AS_OF_YEAR, SIMILARITY, _genre, _profile, _scored, query
from .reports import _artist_xy
from .streams import _scratch


# scalars and joins

@query("b10_tempo_deviation", "select track_id, round(abs(tempo - (select avg(tempo) from audio_features)), 4) as deviation from audio_features where tempo is not null")
def _(lib):
    mean = lib.audio_features.agg(F.avg("tempo").alias("mean")).withColumn("one", F.lit(1))
    rows = lib.audio_features.filter("tempo is not null").withColumn("one", F.lit(1)).join(F.broadcast(mean), "one")
    return rows.select("track_id", F.round(F.abs(F.col("tempo") - F.col("mean")), 4).alias("deviation"))


@query("b14_plain_cosine", "select c.vec_id, round(sum(c.x * m.x) / (coalesce(nullif(sqrt(sum(c.x * c.x)), 0), 1) * sqrt(sum(m.x * m.x))), 6) as cosine from cells c join centres m using (label, i) group by 1", _CENTRES)
def _(lib):
    v = _vectors(lib)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    both = v.join(F.broadcast(clusters.label_centroids(v, "embedding", "label")), "label")  # one centre a label
    size = F.coalesce(F.nullif(F.sqrt(dot("embedding", "embedding")), F.lit(0.0)), F.lit(1.0))
    return both.select("vec_id", F.round(dot("embedding", "centre") / (size * F.sqrt(dot("centre", "centre"))), 6).alias("cosine"))


@query("b15_plane_distance", "select g.track_id, round(sqrt((g.top - x.top) ** 2 + (g.\"left\" - x.\"left\") ** 2), 6) as distance from track_genre g join axy x on x.artist_id = (select min(artist_id) from track_artists a where a.track_id = g.track_id)",
       "axy as (select artist_id, avg(top) as top, avg(\"left\") as \"left\" from track_artists join track_genre using (track_id) where top is not null group by 1)")
def _(lib):
    first = lib.track_artists.groupBy("track_id").agg(F.min("artist_id").alias("artist_id"))
    centre = lib.track_artists.join(_genre(lib), "track_id").filter("top is not null").groupBy("artist_id").agg(F.avg("top").alias("top0"), F.avg("left").alias("left0"))
    rows = _genre(lib).join(first, "track_id").join(centre, "artist_id")
    return rows.select("track_id", F.round(S.distance(F.col("top"), F.col("left"), F.col("top0"), F.col("left0")), 6).alias("distance"))


_NAMES = "names as (select distinct lower(p_brand) as name from part union select distinct substr(p_brand, 1, 7) from part union select distinct substr(p_brand, 6) from part union select distinct p_type from part)"
_RESOLVED = _NAMES + ", resolved as (select name, coalesce((select min(first_genre) from genre_xy where lower(first_genre) = lower(name)), (select min(first_genre) from genre_xy where contains(lower(first_genre), lower(name)))) as first_genre from names)"


def _names(lib):
    brand = lib.table("part").select("p_brand", "p_type")
    return brand.select(F.explode(F.array(F.lower("p_brand"), F.substring("p_brand", 1, 7), F.expr("substr(p_brand, 6)"), F.col("p_type"))).alias("name")).distinct()


@query("b18_genre_match", "select name, first_genre from resolved where first_genre is not null", _RESOLVED)
def _(lib):
    return genres.resolve(_names(lib), lib.genre_xy)


@query("c09_genre_zone", "select name, count(*) as n, round(max(sqrt((g.top - x.top) ** 2 + (g.\"left\" - x.\"left\") ** 2)), 6) as farthest from resolved join genre_xy x using (first_genre) join track_genre g on sqrt((g.top - x.top) ** 2 + (g.\"left\" - x.\"left\") ** 2) <= 800 group by 1", _RESOLVED)
def _(lib):
    found = genres.zone(_names(lib), lib.genre_xy, _genre(lib), 800.0)
    return found.groupBy("name").agg(F.count("*").alias("n"), F.round(F.max("enoa_distance"), 6).alias("farthest"))


@query("b19_rank_percent", "select track_id, round(100.0 * rank / n, 1) as percent, rank - fave_rank as moved from (select track_id, row_number() over (order by popularity desc, track_id) - 1 as rank, row_number() over (order by fave_score desc, track_id) - 1 as fave_rank, count(*) over () as n from profile)", _PROFILE_SQL)
def _(lib):
    rows = _profile(lib).select("track_id", "popularity", "fave_score")
    n = rows.count()
    a, b = _places(rows, "popularity", "rank"), _places(rows, "fave_score", "fave_rank")
    return a.join(b, "track_id").select("track_id", F.round(100.0 * F.col("rank") / n, 1).alias("percent"), (F.col("rank") - F.col("fave_rank")).alias("moved"))


def _places(rows, by, name):
    """Place of each row, from 0, by a column downwards, ties by track_id: places within a value, and how many rows lie above it."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    above = sizes.select(by, (F.sum("n").over(Window.orderBy(F.desc(by))) - F.col("n")).alias("above"))  # a row for each different value
    within = F.row_number().over(Window.partitionBy(by).orderBy("track_id")) - 1
    return rows.withColumn("within", within).join(above, by).select("track_id", (F.col("above") + F.col("within")).alias(name))


@query("b21_membership", "select track_id, track_id in (select track_id from faves) as faved, track_id not in (select track_id from audio_features) as silent from tracks")
def _(lib):
    flag = lambda df, name: df.select("track_id").distinct().withColumn(name, F.lit(True))
    rows = lib.tracks.select("track_id").join(flag(lib.faves, "f"), "track_id", "left").join(flag(lib.audio_features, "a"), "track_id", "left")
    return rows.select("track_id", F.isnotnull("f").alias("faved"), F.isnull("a").alias("silent"))


@query("b23_null_fill", "select track_id, coalesce(popularity, 0) as popularity, coalesce(first_genre, genre_cat) as genre, coalesce(tempo, 120.0) as tempo from profile", _PROFILE_SQL)
def _(lib):
    return _profile(lib).fillna({"popularity": 0.0, "tempo": 120.0}).select("track_id", "popularity", F.coalesce("first_genre", "genre_cat").alias("genre"), "tempo")


@query("c02_corpus", "select track_id as id, track_name, first_genre, gen_4, popularity, fave_score from profile", _PROFILE_SQL)
def _(lib):
    return _profile(lib).withColumnRenamed("track_id", "id").select("id", "track_name", "first_genre", "gen_4", "popularity", "fave_score")


@query("c07_artist_medians_of_tracks", "select track_id, artist_id, round(tempo, 4) as tempo, round(energy, 4) as energy from track_artists join (select artist_id, median(tempo) as tempo, median(energy) as energy from audio_features join track_artists using (track_id) group by 1) using (artist_id)")
def _(lib):
    medians = profile.medians(lib.audio_features.join(lib.track_artists, "track_id"), ["artist_id"]).select("artist_id", "tempo", "energy")
    return lib.track_artists.join(medians, "artist_id").select("track_id", "artist_id", F.round("tempo", 4).alias("tempo"), F.round("energy", 4).alias("energy"))


@query("c10_near_queries", "select request_id, count(*) filter (where score >= 0.9) as near from (select request_id, score, row_number() over (partition by request_id order by score desc, track_id) as rank from scored) where rank <= 500 group by 1", f"{_PROFILE_SQL}, {_IMPUTED}, {_SCORED}")
def _(lib):
    return _scored(lib, 500).groupBy("request_id").agg(F.count_if(F.col("score") >= 0.9).alias("near"))


@query("c11_shared_tracks", "select a.playlist_id as a, b.playlist_id as b, count(*) as shared from members a join members b using (track_id) where a.playlist_id < b.playlist_id group by 1, 2")
def _(lib):
    return profile.shared_items(lib.members, "playlist_id", "track_id")


# aggregates and orders

@query("d12_playlist_means", "select playlist_id, count(*) as size, " + ", ".join(f"round(avg({c}), 8) as {c}" for c in AUDIO) + " from members join audio_features using (track_id) group by 1")
def _(lib):
    return lib.members.join(lib.audio_features, "track_id").groupBy("playlist_id").agg(F.count("*").alias("size"), *(F.round(F.avg(c), 8).alias(c) for c in AUDIO))


@query("d13_ranges", " union all ".join(f"select '{c}' as feature, round(min({c}), 6) as low, round(max({c}), 6) as high, round(case when max({c}) > min({c}) then max({c}) - min({c}) else 1 end, 6) as range from audio_features" for c in AUDIO))
def _(lib):
    long = lib.audio_features.unpivot([], AUDIO, "feature", "value").groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return long.select("feature", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(width, 6).alias("range"))


@query("e01_top_genre_of_playlist", "select playlist_id, first_genre, n from (select playlist_id, first_genre, count(*) as n, row_number() over (partition by playlist_id order by count(*) desc, first_genre) as r from members join tracks using (track_id) where first_genre is not null group by 1, 2) where r = 1")
def _(lib):
    counts = lib.members.join(lib.tracks, "track_id").filter("first_genre is not null").groupBy("playlist_id", "first_genre").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("playlist_id").orderBy(F.desc("n"), "first_genre"))
    return counts.withColumn("r", place).filter("r = 1").drop("r")


@query("e03_place_in_genre", "select track_id, first_genre, row_number() over (partition by first_genre order by popularity desc, track_id) - 1 as place from tracks where first_genre is not null")
def _(lib):
    place = F.row_number().over(Window.partitionBy("first_genre").orderBy(F.desc("popularity"), "track_id")) - 1
    return lib.tracks.filter("first_genre is not null").select("track_id", "first_genre", place.cast("long").alias("place"))


@query("e04_first_genres_of_artist", "select artist_id, string_agg(first_genre, ',' order by n desc, first_genre) as genres from (select artist_id, first_genre, count(*) as n, row_number() over (partition by artist_id order by count(*) desc, first_genre) as r from track_artists join tracks using (track_id) where first_genre is not null group by 1, 2) where r <= 3 group by 1")
def _(lib):
    counts = lib.track_artists.join(lib.tracks, "track_id").filter("first_genre is not null").groupBy("artist_id", "first_genre").agg(F.count("*").alias("n"))
    listed = counts.groupBy("artist_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_genre"))).alias("g"))  # different genres of an artist
    return listed.select("artist_id", F.array_join(F.transform(F.slice("g", 1, 3), lambda x: x["first_genre"]), ",").alias("genres"))


@query("e06_top_of_each_then_fill", "select track_id, first_genre from (select *, row_number() over (order by case when place <= 2 then 0 else 1 end, popularity desc, track_id) as pick from (select *, row_number() over (partition by first_genre order by popularity desc, track_id) as place from tracks where first_genre is not null)) where pick <= 60")
def _(lib):
    place = F.row_number().over(Window.partitionBy("first_genre").orderBy(F.desc("popularity"), "track_id"))
    rows = lib.tracks.filter("first_genre is not null").withColumn("place", place)
    return rows.orderBy((F.col("place") > 2).cast("int"), F.desc("popularity"), "track_id").limit(60).select("track_id", "first_genre")


@query("k03_provenance", "select features_source, count(*) as n from imputed group by 1", f"{_PROFILE_SQL}, {_IMPUTED}")
def _(lib):
    return _corpus(lib).groupBy("features_source").agg(F.count("*").alias("n"))


@query("h02_memberships", "select vec_id, round(sum(p), 6) as total, count(*) as clusters from probs group by 1", _PROBS)
def _(lib):
    rows = _probs(lib)
    return rows.select("vec_id", F.round(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("probs").cast("long").alias("clusters"))


_SILHOUETTE = (
    "cells as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), "
    "moments as (select label, i, count(*) as n, avg(x) as m, avg(x * x) as q from cells group by 1, 2), "
    "gaps as (select c.vec_id, c.label as own, g.label, any_value(g.n) as n, sum(c.x * c.x - 2 * c.x * g.m + g.q) as d from cells c join moments g using (i) group by 1, 2, 3), "
    "ab as (select vec_id, own, max(case when label = own and n > 1 then d * n / (n - 1) end) as a, min(case when label <> own then d end) as b from gaps group by 1, 2), "
    "rows_ as (select vec_id, own as label, case when a is null or b is null then 0.0 else (b - a) / greatest(a, b) end as s from ab)"
)


@query("h06_silhouettes", "select label, count(*) as n, round(avg(s), 5) as mean, round(min(s), 5) as least, count(*) filter (where s < 0) as misplaced from rows_ group by 1", _SILHOUETTE)
def _(lib):
    rows = clusters.silhouettes(_vectors(lib), "embedding", "vec_id", "label")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 5).alias("mean"), F.round(F.min("silhouette"), 5).alias("least"), F.count_if(F.col("silhouette") < 0).alias("misplaced"))


# the feature matrix

@query("f08_feature_matrix")
def _(lib):
    labels = lib.table("orders").select(F.col("o_orderkey").alias("playlist_id"), F.col("o_orderstatus").alias("label"))
    first = lib.track_artists.groupBy("track_id").agg(F.min("artist_id").alias("artist_id"))
    places = _genre(lib).join(first, "track_id", "left").join(_artist_xy(lib).toDF("artist_id", "at", "al"), "artist_id", "left")
    places = places.select("track_id", F.coalesce("at", "top").alias("top"), F.coalesce("al", "left").alias("left"))
    vectors = lib.table("embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = _profile(lib).withColumn("year", S.year_of(F.col("release_date")))
    made = matrix.feature_matrix(rows, lib.track_artists, lib.playlist_tracks, labels, lib.members, lib.audio_features, places, vectors, AS_OF_YEAR, 64)
    r = lambda c, n=6: F.round(c, n).alias(c)
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("vector_total")
    return made.select("track_id", "features_source", "n_playlists", "playlist_diversity", r("year_normalized"), "years_since_release", r("top"), r("left"), r("tempo", 4), r("energy", 4), r("pp_tempo"), "popularity", "fave_score", total)


_SQL["f08_feature_matrix"] = (
    f"select f01.track_id, f01.features_source, n_playlists, playlist_diversity, year_normalized, years_since_release, coalesce(top, 0) as top, coalesce(\"left\", 0) as \"left\", f01.tempo, f01.energy, pp_tempo, p.p_size::double as popularity, "
    "case when p.p_partkey % 5 = 0 then p.p_size / 10 else 0.0 end as fave_score, f07.total as vector_total "
    f"from ({_SQL['f01_impute']}) f01 join ({_SQL['f02_collaborative']}) f02 using (track_id) join ({_SQL['f03_temporal']}) f03 using (track_id) join ({_SQL['f04_artist_coordinates']}) f04 using (track_id) "
    f"left join ({_SQL['f05_playlist_profile']}) f05 using (track_id) join ({_SQL['f07_with_vectors']}) f07 using (track_id) join part p on p.p_partkey = f01.track_id"
)

@query("f11_categories", "select track_id, coalesce(gen_4, '_unknown_') as gen_4, coalesce(nullif(first_genre, ''), '_unknown_') as first_genre from track_genre")
def _(lib):
    return matrix.categories(_genre(lib), ["gen_4", "first_genre"]).select("track_id", "gen_4", "first_genre")


# seeds, nearest rows, sessions, neighbours

@query("g02_resolved_seeds", "select event_id, t.track_id is not null as known, case when t.track_id is null then 'unknown id ' || coalesce(cast(item * 40 as varchar), '') end as problem, coalesce(t.popularity, 0) as popularity from plays left join tracks t on t.track_id = item * 40")
def _(lib):
    seeds = lib.plays.select("event_id", (F.col("item") * 40).alias("seed_id"))
    return retrieval.resolved(seeds, lib.tracks.select("track_id", "popularity"), ["popularity"]).select("event_id", "known", "problem", "popularity")


@query("g03_nearest_row", "select request_id, track_id % 8 as cluster_id from (select request_id, track_id, row_number() over (partition by request_id order by score desc, track_id) as rank from scored) where rank = 1", f"{_PROFILE_SQL}, {_IMPUTED}, {_SCORED}")
def _(lib):
    return _scored(lib, 1).select("request_id", (F.col("track_id") % 8).alias("cluster_id"))


_UNIT = "unit as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) as v from embeddings)"


def _units(lib, key, part):
    return _vectors(lib).select(F.col("vec_id").alias(key), F.col("embedding").alias("v"), part.cast("long").alias("part"))


@query("g06_recalled_sessions", "select request_id, vec_id as session_id, round(score, 6) as score from (select q.vec_id as request_id, c.vec_id, round(greatest(0, least(1, list_dot_product(q.v, c.v))), 9) as score, row_number() over (partition by q.vec_id order by round(greatest(0, least(1, list_dot_product(q.v, c.v))), 9) desc, c.vec_id) as r from unit q join unit c on q.label = c.label where q.vec_id % 100 = 0) where r <= 2", _UNIT)
def _(lib):
    asked = _units(lib, "request_id", F.col("label")).filter("request_id % 100 = 0")
    found = retrieval.best_products(_units(lib, "track_id", F.col("label")), asked, 2, same=True)
    return found.select("request_id", F.col("track_id").alias("session_id"), F.round("score", 6).alias("score"))


@query("h14_neighbour_vote", "select request_id, label as predicted from (select request_id, label, row_number() over (partition by request_id order by count(*) desc, label) as r from (select q.vec_id as request_id, c.label, row_number() over (partition by q.vec_id order by round(greatest(0, least(1, list_dot_product(q.v, c.v))), 9) desc, c.vec_id) as k from unit q join unit c on q.vec_id % 5 <> c.vec_id % 5) where k <= 15 group by 1, 2) where r = 1", _UNIT)
def _(lib):
    """Five folds by id: each vector's label by a vote of its 15 nearest in the other folds."""
    fold = F.pmod("vec_id", F.lit(5))
    near = retrieval.best_products(_units(lib, "track_id", fold), _units(lib, "request_id", fold), 15, apart=True)
    votes = near.join(_vectors(lib).select(F.col("vec_id").alias("track_id"), "label"), "track_id")
    return profile.mode_of(votes, "request_id", "label").select("request_id", F.col("label").alias("predicted"))


_POINTS = "points as (select row_number() over (order by first_genre) as id, top, \"left\" from genre_xy), near as (select a.id as a, b.id as b from points a join points b on sqrt((a.top - b.top) ** 2 + (a.\"left\" - b.\"left\") ** 2) <= 700), core as (select a from near group by 1 having count(*) >= 3)"


@query("h09_dense_groups", "select first_genre, coalesce(min(r.b), -1) as cluster_id from (select row_number() over (order by first_genre) as id, first_genre from genre_xy) p left join (select n.a as id, reach.b from near n join core on n.b = core.a join reach on reach.a = n.b) r using (id) group by 1",
       _POINTS + ", cc as (select a, b from near where a in (from core) and b in (from core)), reach as (with recursive r as (select a, b from cc union select r.a, cc.b from r join cc on r.b = cc.a) select a, min(b) as b from r group by 1)")
def _(lib):
    order = Window.orderBy("first_genre")  # a row for each genre of the plane
    points = lib.genre_xy.select("first_genre", "top", "left").withColumn("id", F.row_number().over(order).cast("long"))
    return points.join(clusters.dense_groups(points, 700.0, 3), "id").select("first_genre", "cluster_id")


# classifiers of playlists, reranking, requests

_POSITIVES = "held as (select playlist_id, count(*) as positives from (select distinct playlist_id, track_id from members join tracks using (track_id)) group by 1)"


@query("j05_trained", "select playlist_id, positives, positives >= 20 as trained from held", _POSITIVES)
def _(lib):
    """Which playlists get a classifier: those with enough members in the corpus."""
    models = learners.group_labels(lib.members, lib.tracks).select("playlist_id", F.lit(True).alias("fitted")).distinct()
    held = lib.members.join(lib.tracks.select("track_id"), "track_id").distinct().groupBy("playlist_id").agg(F.count("*").alias("positives"))
    return held.join(models, "playlist_id", "left").select("playlist_id", "positives", F.coalesce("fitted", F.lit(False)).alias("trained"))


def _vectors_of(lib):
    return matrix.rerank_vectors(_corpus(lib), AUDIO, ["popularity", "top", "left", "fave_score"]).withColumnRenamed("vector", "features")


def _group_rows(lib):
    vectors = _vectors_of(lib)
    return learners.group_labels(lib.members, vectors).join(vectors, "track_id")


@query("i07_reranked")
def _(lib):
    """The 20 tracks most similar to each playlist, placed by the playlist's classifier."""
    rows, vectors = _group_rows(lib), _vectors_of(lib)
    corpus = _corpus(lib)
    asked = lib.members.withColumnRenamed("playlist_id", "request_id")
    near = retrieval.similar(corpus, recommend.centroids(corpus, asked, SIMILARITY), SIMILARITY, 20).select("request_id", "track_id", "score")
    wanted = near.select(F.col("request_id").alias("playlist_id"), "track_id").join(vectors, "track_id")
    scored = learners.score_groups(wanted, learners.fit_groups(rows, rounds=60)).withColumnRenamed("playlist_id", "request_id")
    return recommend.reranked(near, scored, ["request_id", "track_id"]).select("request_id", "track_id", "place", F.round("probability", 6).alias("probability"))


_REQUESTS = (
    "asked as (select track_id as request_id, case track_id % 4 when 0 then 'track' when 1 then 'artist' when 2 then 'genre' else 'mood' end as request_type, cast(case when track_id % 500 = 0 then 0 else 3 end as integer) as k, "
    "case track_id % 4 when 0 then track_id when 1 then track_id // 10 else track_id end as seed_id from tracks where track_id % 100 < 4 and track_id > 3)"
)


@query("i09_routed", "select a.request_id, request_type, r.rank, r.track_id, round(r.score, 6) as score, case when request_type = 'mood' then 'type' when k = 0 then 'k' when r.track_id is null then 'nothing found' end as problem from asked a left join ("
       "select request_id, track_id, score, row_number() over (partition by request_id order by score desc, track_id) as rank from (select q.request_id, c.track_id, round(greatest(0, least(1, (" + " + ".join(f'coalesce(c."{c}", 0) * coalesce(q."{c}", 0)' for c in SIMILARITY)
       + ") / (sqrt(" + " + ".join(f'coalesce(c."{c}", 0) ** 2' for c in SIMILARITY) + ") * sqrt(" + " + ".join(f'coalesce(q."{c}", 0) ** 2' for c in SIMILARITY) + ")))), 9) as score from vec q, imputed c)) r on r.request_id = a.request_id and r.rank <= a.k and a.request_type <> 'mood' and a.k > 0",
       f"{_PROFILE_SQL}, {_IMPUTED}, {_REQUESTS}, vec as (select request_id, " + ", ".join(f'i."{c}"' for c in SIMILARITY) + " from asked join imputed i on i.track_id = seed_id where request_type = 'track' union all select request_id, "
       + ", ".join(f'avg(coalesce(i."{c}", 0))' for c in SIMILARITY) + " from asked join track_artists ta on ta.artist_id = seed_id join imputed i on i.track_id = ta.track_id where request_type = 'artist' group by 1)")
def _(lib):
    """Requests of several kinds, wrong ones among them, through the pipelines of their kinds. Genre requests have no pipeline here, so they
    find nothing."""
    corpus, t = _corpus(lib), F.col("track_id")
    kind = F.when(t % 4 == 0, "track").when(t % 4 == 1, "artist").when(t % 4 == 2, "genre").otherwise("mood")
    seed = F.when(t % 4 == 1, F.floor(t / 10)).otherwise(t)
    asked = lib.tracks.filter("track_id % 100 < 4 and track_id > 3").select(t.alias("request_id"), kind.alias("request_type"), F.when(t % 500 == 0, 0).otherwise(3).alias("k"), seed.alias("seed_id"))

    def by_track(requests):
        seeds = requests.select("request_id", "seed_id").join(corpus.select(F.col("track_id").alias("seed_id"), *SIMILARITY), "seed_id")
        return retrieval.similar(corpus, seeds, SIMILARITY, 50)

    def by_artist(requests):
        tracks = requests.select("request_id", "seed_id").join(lib.track_artists.select(F.col("artist_id").alias("seed_id"), "track_id"), "seed_id")
        return retrieval.similar(corpus, recommend.centroids(corpus, tracks.select("request_id", "track_id"), SIMILARITY), SIMILARITY, 50)

    found = recommend.routed(asked, {"track": by_track, "artist": by_artist})
    return found.select("request_id", "request_type", "rank", "track_id", F.round("score", 6).alias("score"), "problem")


# orders of steps, sessions, streams, results

@query("l08_profile_refresh", f"select 'artist' as kind, cast(artist_id as varchar) as id, track_count, gen_4 from ({_SQL['d06_artist_genre']}) union all select 'playlist', playlist_id, track_count, gen_4 from ({_SQL['d07_playlist_genre']})")
def _(lib):
    genre = _genre(lib)
    artist = profile.group_profile(lib.track_artists, genre, "artist_id").select(F.lit("artist").alias("kind"), F.col("artist_id").cast("string").alias("id"), "track_count", "gen_4")
    return artist.unionByName(profile.group_profile(lib.members, genre, "playlist_id").select(F.lit("playlist").alias("kind"), F.col("playlist_id").alias("id"), "track_count", "gen_4"))


@query("l09_full_sync", "select playlist_id, count(*) filter (where removed_at is null) as active, count(*) filter (where removed_at is not null) as removed, count(*) filter (where removed_at is null and first_genre is not null) as with_genre from (select coalesce(o.playlist_id, s.playlist_id) as playlist_id, coalesce(o.track_id, s.track_id) as track_id, case when s.track_id is null then '2026-01-01' end as removed_at from (select * from members where track_id % 9 <> 0) o full join (select * from members where track_id % 7 <> 0) s on o.playlist_id = s.playlist_id and o.track_id = s.track_id) join tracks using (track_id) group by 1")
def _(lib):
    """Membership sync, then genres of the tracks, then counts: one job over landed tables."""
    old = lib.members.filter("track_id % 9 <> 0").withColumn("removed_at", F.lit(None).cast("string"))
    synced = merge.sync_members(old, lib.members.filter("track_id % 7 <> 0"), lib.members.select("playlist_id").distinct(), "2026-01-01")
    rows = synced.join(_genre(lib).select("track_id", "first_genre"), "track_id")
    active = F.col("removed_at").isNull()
    return rows.groupBy("playlist_id").agg(F.count_if(active).alias("active"), F.count_if(~active).alias("removed"), F.count_if(active & F.col("first_genre").isNotNull()).alias("with_genre"))


@query("f15_tags_fill_genres", "select track_id, coalesce(first_genre, tag) as genre, case when a.track_id is null and first_genre is null and tag is not null then 'lastfm' else a.features_source end as features_source from tracks left join (select p_partkey as track_id, case p_size % 3 when 0 then 'jazz' when 1 then 'rock' end as tag from part) g using (track_id) left join audio_features a using (track_id)")
def _(lib):
    tag = F.when(F.col("p_size") % 3 == 0, "Jazz").when(F.col("p_size") % 3 == 1, "Rock")
    landed = lib.table("part").select(F.col("p_partkey").alias("track_id"), F.to_json(F.struct(F.struct(tag.alias("name"), F.lit(7).alias("count")).alias("tag"))).alias("payload"))
    tags = landed.select("track_id", F.get(payloads.tags_of(F.col("payload")), 0).alias("tag"))
    rows = lib.tracks.join(tags, "track_id", "left").join(lib.audio_features.select("track_id", "features_source"), "track_id", "left")
    stub = F.col("features_source").isNull() & F.col("first_genre").isNull() & F.col("tag").isNotNull()
    return rows.select("track_id", F.coalesce("first_genre", "tag").alias("genre"), F.when(stub, "lastfm").otherwise(F.col("features_source")).alias("features_source"))


@query("m18_session_blocks", "select conv_id, string_agg(r || '. ' || text, chr(10) order by r) as block from (select conv_id, text, row_number() over (partition by conv_id order by turn desc) as r from turns where role = 'user') where r <= 3 group by 1")
def _(lib):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = lib.turns.filter("role = 'user'").withColumn("r", place).filter("r <= 3")
    lines = F.array_sort(F.collect_list(F.struct("r", F.concat(F.col("r").cast("string"), F.lit(". "), F.col("text")).alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


@query("n05_stream_members", "select user_id, item, event_type <> 'purchase' as active from (select user_id, item, arg_max(event_type, event_id) as event_type from plays where item is not null and user_id is not null group by 1, 2)")
def _(lib):
    folder = _scratch(lib)
    schema = lib.table("events").schema
    rows = plays.read(lib.spark, lib.folder, schema, "events.parquet").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("item"))
    plays.upsert_members(rows.filter("item is not null and user_id is not null"), f"{folder}/out", f"{folder}/state", ["user_id", "item"])
    return plays.latest_members(lib.spark, f"{folder}/out", ["user_id", "item"]).select("user_id", "item", (F.col("event_type") != "purchase").alias("active"))


# files in and out: written from the tables at hand to the shared folder, and read back

def _folder(lib) -> str:
    return new_folder(lib.spark, "files")


@query("a01_play_history", "select track_name, sum(ms_played) as ms_played, count(*) as plays from (select 'T' || item as track_name, cast(value * 1000 as bigint) as ms_played from events join plays using (event_id)) group by 1")
def _(lib):
    folder = _folder(lib)
    rows = lib.table("events").select("event_id", "value").join(lib.plays.select("event_id", "item"), "event_id")
    rows.select(F.lit("2026").alias("ts"), F.expr("cast(floor(value * 1000 + 0.5) as long)").alias("ms_played"), F.concat(F.lit("T"), F.col("item").cast("string")).alias("master_metadata_track_name")).write.json(folder)
    return files.play_history(lib.spark, folder, lines=True).groupBy(F.nullif("track_name", F.lit("")).alias("track_name")).agg(F.sum("ms_played").alias("ms_played"), F.count("*").alias("plays"))


@query("a02_history_defaults", "select count(*) as n, sum(case when track_id % 11 = 0 then 1 else 0 end) as unnamed, sum(case when track_id % 3 = 0 then 0 else track_id end) as ms_played from tracks")
def _(lib):
    folder = _folder(lib)
    name = F.when(F.col("track_id") % 11 != 0, F.col("track_name")).alias("master_metadata_track_name")
    lib.tracks.select(F.lit("2026").alias("ts"), name, F.when(F.col("track_id") % 3 != 0, F.col("track_id")).alias("ms_played")).write.json(folder)
    rows = files.play_history(lib.spark, folder, lines=True)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("track_name") == "").alias("unnamed"), F.sum("ms_played").alias("ms_played"))


@query("a03_parquet_cache", "select track_id, tempo from audio_features")
def _(lib):
    path = _folder(lib)
    payloads.cached(lib.spark, path, lambda: lib.audio_features)
    return payloads.cached(lib.spark, path, lambda: lib.audio_features.limit(0)).select("track_id", "tempo")  # the second finds the first's table


@query("a04_genre_map_cache", "select first_genre, gen_4, gen_8, row_number() over (order by gen_4, gen_8, first_genre) as place from genre_map")
def _(lib):
    folder = _folder(lib)
    place = F.row_number().over(Window.orderBy("gen_4", "gen_8", "first_genre"))  # a row for each genre of the map
    lib.genre_map.select("first_genre", "gen_4", "gen_8").withColumn("place", place).write.option("header", True).csv(folder)
    return lib.spark.read.option("header", True).schema("first_genre string, gen_4 string, gen_8 string, place int").csv(folder)


@query("a05_csv_concat", "select cast(track_id as varchar) as track_id, case when track_id % 2 = 0 then cast(popularity as integer) end as popularity, case when track_id % 2 = 1 then genre_cat end as genre_cat from tracks")
def _(lib):
    folder = _folder(lib)
    lib.tracks.filter("track_id % 2 = 0").select(F.col("popularity").cast("int").alias("popularity"), "track_id").write.option("header", True).csv(f"{folder}/a")
    lib.tracks.filter("track_id % 2 = 1").select("track_id", "genre_cat").write.option("header", True).csv(f"{folder}/b")
    return files.csv_tables(lib.spark, [f"{folder}/a", f"{folder}/b"]).select("track_id", F.col("popularity").cast("int").alias("popularity"), "genre_cat")


@query("a08_dirty_numbers", "select artist_id, artist_name, try_cast(round(popularity, 2) as double) as popularity from artists")
def _(lib):
    folder = _folder(lib)
    dirty = F.concat(F.lit("~ "), F.abs(F.round("popularity", 2)).cast("string"), F.lit(" pts"))
    lib.artists.select("artist_id", "artist_name", (F.col("popularity") < 0).alias("below"), dirty.alias("popularity")).write.option("header", True).csv(folder)
    rows = lib.spark.read.option("header", True).schema("artist_id long, artist_name string, below boolean, popularity string").csv(folder)
    number = S.number_in(F.col("popularity"))
    return rows.select("artist_id", "artist_name", F.when(F.col("below"), -number).otherwise(number).alias("popularity"))


@query("a09_coordinates", "select t.track_id, case when x.first_genre is not null then x.top else 1.0 end as top, case when x.first_genre is not null then x.\"left\" else 2.0 end as \"left\" from tracks t left join genre_xy x using (first_genre)")
def _(lib):
    old = lib.tracks.select("track_id", "first_genre", F.lit(1.0).alias("top"), F.lit(2.0).alias("left"))
    new = lib.genre_xy.select("first_genre", F.col("top").alias("t"), F.col("left").alias("l"), F.lit(True).alias("hit"))
    return old.join(new, "first_genre", "left").select("track_id", F.when(F.col("hit"), F.col("t")).otherwise(F.col("top")).alias("top"), F.when(F.col("hit"), F.col("l")).otherwise(F.col("left")).alias("left"))


@query("a10_coordinates_once", "select first_genre, min(top) as top from (select first_genre, top from genre_xy union all select first_genre, top + 1 from genre_xy) group by 1")
def _(lib):
    both = lib.genre_xy.select("first_genre", "top").unionByName(lib.genre_xy.select("first_genre", (F.col("top") + 1).alias("top")))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("first_genre").orderBy("top"))).filter("r = 1").drop("r")


@query("a11_faves", "select track_id, score as fave_score from faves")
def _(lib):
    return merge.insert_if_absent(lib.faves.filter("track_id % 2 = 0").withColumnRenamed("score", "fave_score"), lib.faves.withColumnRenamed("score", "fave_score"), ["track_id"])


@query("a12_wide_export", "select 'tracks' as name, count(*) as n, sum(track_id) as total from (select distinct track_id from members) union all select 'audio_features', count(*), sum(track_id) from (select distinct track_id from members join audio_features using (track_id) where tempo is not null) union all select 'playlist_tracks', count(*), sum(track_id) from members union all select 'track_artists', count(*), sum(track_id) from (select distinct track_id, artist_id from members join track_artists using (track_id)) union all select 'artists', count(*), sum(artist_id) from (select distinct artist_id from members join track_artists using (track_id))")
def _(lib):
    folder = _folder(lib)
    by = lib.track_artists.join(lib.artists, "artist_id").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("artist_id", "artist_name"))).alias("a"))
    text = lambda field: F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: F.concat(F.lit("'"), x[field].cast("string"), F.lit("'"))), ", "), F.lit("]"))
    wide = lib.members.join(lib.tracks.select("track_id", "track_name", "popularity"), "track_id").join(lib.audio_features.select("track_id", "tempo", "energy"), "track_id", "left").join(by, "track_id", "left")
    wide.select("playlist_id", "track_id", "track_name", "popularity", "tempo", "energy", text("artist_id").alias("artist_ids"), text("artist_name").alias("artist_names")).write.option("header", True).csv(folder)
    kinds = "playlist_id string, track_id long, track_name string, popularity double, tempo double, energy double, artist_ids string, artist_names string"
    made = payloads.normalised(lib.spark.read.option("header", True).schema(kinds).csv(folder))
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(F.col("artist_id" if name == "artists" else "track_id").cast("long")).alias("total")) for name, df in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("a13_typed_csv", "select track_id as id, case when track_id % 5 <> 0 then popularity end as popularity, track_name as name from tracks")
def _(lib):
    folder = _folder(lib)
    pop = F.when(F.col("track_id") % 10 == 0, "NA").when(F.col("track_id") % 5 == 0, "x").otherwise(F.col("popularity").cast("string"))
    rows = lib.tracks.select("track_id", pop.alias("popularity"), "track_name", "genre_cat")
    rows.union(rows).write.option("header", True).csv(folder)
    return payloads.typed_csv(lib.spark, folder, {"track_id": "long", "popularity": "double", "track_name": "string"}, {"track_id": "id", "track_name": "name"}, files.MISSING)


@query("a15_first_source", "select track_id, popularity from tracks")
def _(lib):
    folder = _folder(lib)
    return payloads.first_source([lambda: lib.spark.read.parquet(f"{folder}/none"), lambda: lib.tracks.limit(0).select("track_id", "popularity"), lambda: lib.tracks.select("track_id", "popularity")])


@query("a16_metrics_files", "select cast(playlist_id as varchar) as playlist_id, 'model' as kind, round(avg(tempo), 4) as value from members join audio_features using (track_id) group by 1 union all select '', 'summary', round(avg(tempo), 4) from audio_features")
def _(lib):
    folder = _folder(lib)
    rows = lib.members.join(lib.audio_features, "track_id").groupBy("playlist_id").agg(F.avg("tempo").alias("value")).withColumn("kind", F.lit("model"))
    whole = lib.audio_features.agg(F.avg("tempo").alias("value")).select(F.lit("").alias("playlist_id"), "value", F.lit("summary").alias("kind"))
    files.write_metrics(rows.unionByName(whole), folder)
    return files.read_metrics(lib.spark, folder).select("playlist_id", "kind", "value")


@query("a20_track_payloads", "select p_partkey as track_id, p_name as track_name, 'a' || p_partkey || '|b' || p_size as artist_ids from part where p_partkey % 13 <> 0")
def _(lib):
    folder = _folder(lib)
    artist = lambda i, c: F.struct(F.concat(F.lit(i), F.col(c).cast("string")).alias("id"), F.lit("n").alias("name"))
    track = F.struct(F.when(F.col("p_partkey") % 13 != 0, F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.array(artist("a", "p_partkey"), artist("b", "p_size")).alias("artists"))
    lib.table("part").groupBy(F.pmod("p_partkey", F.lit(50)).alias("page")).agg(F.collect_list(F.struct(track.alias("track"))).alias("items")).write.json(folder)
    got = files.payload_tracks(lib.spark.read.schema("items array<struct<track:struct<id:bigint,name:string,artists:array<struct<id:string,name:string>>>>>").json(folder))
    return got.select("track_id", "track_name", F.array_join("artist_ids", "|").alias("artist_ids"))


@query("a21_feature_payloads", "select track_id, coalesce(danceability, 0) as danceability, coalesce(tempo, 0) as tempo, 4.0 as time_signature from audio_features where track_id % 17 <> 0")
def _(lib):
    folder = _folder(lib)
    f = F.when(F.col("track_id") % 17 != 0, F.struct(F.col("track_id").alias("id"), "danceability", "energy", "loudness", "tempo", F.lit(None).cast("int").alias("time_signature")))
    lib.audio_features.groupBy(F.pmod("track_id", F.lit(50)).alias("page")).agg(F.collect_list(f).alias("audio_features")).write.json(folder)
    rows = lib.spark.read.schema("audio_features array<struct<id:bigint,danceability:double,energy:double,loudness:double,tempo:double,time_signature:int>>").json(folder)
    return payloads.feature_rows(rows).select("track_id", "danceability", "tempo", "time_signature")


@query("a22_artist_payloads", "select artist_id, artist_name, case when artist_id % 4 = 0 then '' else 'g1,g2,g3' end as genres, case when artist_id % 2 = 0 then 0 else artist_id end as followers from artists")
def _(lib):
    folder = _folder(lib)
    tags = F.when(F.col("artist_id") % 4 != 0, F.array(*(F.lit(f"g{i}") for i in range(1, 6))))
    a = F.struct(F.col("artist_id").alias("id"), F.col("artist_name").alias("name"), tags.alias("genres"), F.when(F.col("artist_id") % 2 != 0, F.struct(F.col("artist_id").alias("total"))).alias("followers"))
    lib.artists.groupBy(F.pmod("artist_id", F.lit(20)).alias("page")).agg(F.collect_list(a).alias("artists")).write.json(folder)
    rows = lib.spark.read.schema("artists array<struct<id:bigint,name:string,genres:array<string>,followers:struct<total:bigint>>>").json(folder)
    return payloads.artist_rows(rows).withColumn("genres", F.array_join("genres", ","))


@query("a23_album_payloads", "select p_brand as album_id, min(p_type) as album_name, count(*) as total_tracks from part group by 1")
def _(lib):
    folder = _folder(lib)
    albums = lib.table("part").groupBy(F.col("p_brand").alias("id")).agg(F.min("p_type").alias("name"), F.count("*").alias("total_tracks")).withColumn("release_date", F.lit("2020"))
    albums.groupBy(F.substring("id", 1, 7).alias("page")).agg(F.collect_list(F.struct("id", "name", "release_date", "total_tracks")).alias("items")).write.json(folder)
    rows = lib.spark.read.schema("items array<struct<id:string,name:string,release_date:string,total_tracks:bigint>>").json(folder)
    return payloads.album_rows(rows).select("album_id", "album_name", "total_tracks")


@query("a24_tag_payloads", "select p_partkey as track_id, case when p_partkey % 3 = 0 then 'jazz' when p_partkey % 3 = 1 and p_size >= 5 then 'rock,soul' when p_partkey % 3 = 1 then 'soul' else '' end as tags from part")
def _(lib):
    tag = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("long").alias("count"))
    one, many = F.to_json(F.struct(tag("Jazz", F.lit(9)).alias("tag"))), F.to_json(F.struct(F.array(tag("Rock", F.col("p_size")), tag("SOUL", F.lit(50)), tag("rare", F.lit(1))).alias("tag")))
    payload = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, many)
    return lib.table("part").select(F.col("p_partkey").alias("track_id"), F.array_join(payloads.tags_of(payload), ",").alias("tags"))


@query("a25_vectors_by_version", "select vec_id, case when vec_id % 2 = 0 then 'v2' else 'v1' end as model_version from embeddings")
def _(lib):
    folder, v = _folder(lib), lib.table("embeddings")
    put = lambda df, version: df.withColumn("model_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version").parquet(folder)
    put(v.filter("vec_id % 2 = 1"), "v1")
    put(v, "v2")
    put(v.filter("vec_id % 2 = 0"), "v2")  # takes the place of the rows of its version
    return lib.spark.read.parquet(folder).select("vec_id", F.col("model_version").cast("string").alias("model_version"))


@query("a27_plane", "select first_genre, top, \"left\" from genre_xy")
def _(lib):
    return payloads.first_source([lambda: lib.genre_xy.select("first_genre", "top", "left")])


@query("o10_results", "select label, n, baseline, n - baseline as change from (select event_type as label, count(*) as n, count(*) filter (where event_id % 2 = 0) as baseline from events group by 1)")
def _(lib):
    """Results written as JSON; the baseline is made from half of the rows where none is stored yet."""
    folder = _folder(lib)
    counts = lambda df: df.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    counts(lib.table("events")).write.json(f"{folder}/now")
    base = payloads.cached(lib.spark, f"{folder}/base", lambda: counts(lib.table("events").filter("event_id % 2 = 0")))
    now = lib.spark.read.schema("label string, n long").json(f"{folder}/now")
    both = now.join(base.toDF("label", "baseline"), "label", "left").fillna({"baseline": 0})
    return both.withColumn("change", F.col("n") - F.col("baseline"))


_STATUS = {"0-BUILDING": "active", "1-BUILDING": "archived", "2-BUILDING": "odd"}
_STATUS_SQL = "case playlist_id when '0-BUILDING' then 'active' when '1-BUILDING' then 'archived' else 'excluded' end"


@query("a06_playlists", f"select playlist_id, {_STATUS_SQL} as status, case when length(playlist_id) % 2 = 0 then upper(playlist_id) else 'old' end as name from (select distinct playlist_id from members)")
def _(lib):
    """Playlists from a CSV put over stored ones: name and status are taken over, the rest stays."""
    folder, ids = _folder(lib), lib.members.select("playlist_id").distinct()
    ids.filter("length(playlist_id) % 2 = 0").select("playlist_id", F.upper("playlist_id").alias("name")).write.option("header", True).csv(folder)
    new = lib.spark.read.option("header", True).schema("playlist_id string, name string").csv(folder)
    both = merge.upsert(ids.withColumn("name", F.lit("old")), new, ["playlist_id"], ["name"])
    return payloads.with_status(both, _STATUS, "playlist_id").select("playlist_id", "status", "name")


@query("a07_taxonomy", "select first_genre, gen_4 from genre_map union all select first_genre, 'new' from genre_xy where n > 18")
def _(lib):
    return merge.insert_if_absent(lib.genre_map.select("first_genre", "gen_4"), lib.genre_xy.select("first_genre", F.lit("new").alias("gen_4")), ["first_genre"])


@query("a14_corpus_cache", "select track_id, features_source, round(tempo, 4) as tempo from imputed", f"{_PROFILE_SQL}, {_IMPUTED}")
def _(lib):
    path = _folder(lib)
    payloads.cached(lib.spark, path, lambda: _corpus(lib))
    return payloads.cached(lib.spark, path, lambda: _corpus(lib)).select("track_id", "features_source", F.round("tempo", 4).alias("tempo"))


@query("a17_metrics_source", "select playlist_id, round(avg(tempo), 4) as tempo, round(avg(energy), 4) as energy from members join audio_features using (track_id) group by 1")
def _(lib):
    """Lines of metrics, the summary line among them, flattened; the summary is left out."""
    folder = _folder(lib)
    one = lib.members.join(lib.audio_features, "track_id").groupBy("playlist_id").agg(F.struct(F.round(F.avg("tempo"), 4).alias("tempo"), F.round(F.avg("energy"), 4).alias("energy")).alias("metrics"))
    whole = lib.audio_features.agg(F.struct(F.avg("tempo").alias("tempo"), F.avg("energy").alias("energy")).alias("metrics"))
    one.withColumn("summary", F.lit(None).cast("boolean")).unionByName(whole.select(F.lit("").alias("playlist_id"), "metrics", F.lit(True).alias("summary"))).write.json(folder)
    rows = lib.spark.read.schema("playlist_id string, metrics struct<tempo:double,energy:double>, summary boolean").json(folder)
    return rows.filter("summary is null").select("playlist_id", "metrics.*")


@query("a18_golden_samples", "select conv_id, turn, text from turns where turn % 3 = 1")
def _(lib):
    folder = _folder(lib)
    lib.turns.select("conv_id", "turn", "text", F.concat(F.lit("tier"), (F.col("turn") % 3).cast("string")).alias("tier")).write.json(folder)
    return lib.spark.read.schema("conv_id long, turn long, text string, tier string").json(folder).filter("tier = 'tier1'").drop("tier")


@query("a19_status_config", f"select playlist_id, {_STATUS_SQL} as status from (select distinct playlist_id from members)")
def _(lib):
    return payloads.with_status(lib.members.select("playlist_id").distinct(), _STATUS, "playlist_id")


@query("a26_saved_model", "select track_id, round((popularity - lo) / (hi - lo), 6) as scaled from tracks, (select min(popularity) as lo, max(popularity) as hi from tracks)")
def _(lib):
    """A fitted scaler is saved under its slug and loaded again; a slug without a model gives none."""
    from pyspark.ml.feature import MinMaxScaler, MinMaxScalerModel
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators import learners

    folder, rows = _folder(lib), lib.tracks.select("track_id", array_to_vector(F.array("popularity")).alias("v"))
    learners.save_model(MinMaxScaler(inputCol="v", outputCol="s").fit(rows), folder, "scaler")
    model = learners.load_model(lib.spark, MinMaxScalerModel, folder, "scaler")
    if learners.load_model(lib.spark, MinMaxScalerModel, folder, "other") is not None:
        raise AssertionError("a model that was never saved")
    return model.transform(rows).select("track_id", F.round(vector_to_array("s")[0], 6).alias("scaled"))


_METRICS = ["tempo", "energy", "valence"]
_BY_PLAYLIST = "m as (select playlist_id, split_part(playlist_id, '-', 2) as model, " + ", ".join(f"avg({c}) as {c}" for c in _METRICS) + " from members join audio_features using (track_id) group by 1)"


def _metric_rows(lib):
    rows = lib.members.join(lib.audio_features, "track_id").groupBy("playlist_id").agg(*(F.avg(c).alias(c) for c in _METRICS))
    return rows.withColumn("model", F.split_part("playlist_id", F.lit("-"), F.lit(2)))


@query("j09_aligned_models", "select metric, count(*) filter (where a > b + 1e-9) as wins, count(*) filter (where b > a + 1e-9) as losses, count(*) filter (where abs(a - b) <= 1e-9) as ties from (" + " union all ".join(f"select '{c}' as metric, x.{c} as a, y.{c} as b from m x join m y on split_part(x.playlist_id, '-', 1) = split_part(y.playlist_id, '-', 1) where x.model = 'BUILDING' and y.model = 'MACHINERY'" for c in _METRICS) + ") group by 1", _BY_PLAYLIST)
def _(lib):
    """Two models on the keys that both have, metric by metric."""
    long = _metric_rows(lib).withColumn("key", F.split_part("playlist_id", F.lit("-"), F.lit(1))).unpivot(["key", "model"], _METRICS, "metric", "value")
    side = lambda model, name: long.filter(F.col("model") == model).select("key", "metric", F.col("value").alias(name))
    both, gap = side("BUILDING", "a").join(side("MACHINERY", "b"), ["key", "metric"]), F.col("a") - F.col("b")
    return both.groupBy("metric").agg(F.count_if(gap > 1e-9).alias("wins"), F.count_if(gap < -1e-9).alias("losses"), F.count_if(F.abs(gap) <= 1e-9).alias("ties"))


@query("j10_metric_correlations", "select model, round(corr(tempo, energy), 5) as tempo_energy, round(corr(tempo, valence), 5) as tempo_valence, round(corr(energy, valence), 5) as energy_valence from m group by 1 having count(*) >= 3", _BY_PLAYLIST)
def _(lib):
    pairs = [("tempo", "energy"), ("tempo", "valence"), ("energy", "valence")]
    out = _metric_rows(lib).groupBy("model").agg(F.count("*").alias("n"), *(F.round(F.corr(a, b), 5).alias(f"{a}_{b}") for a, b in pairs))
    return out.filter("n >= 3").drop("n")


@query("j15_cross_validation", "select round(avg(a), 6) as mean, round(stddev_samp(a), 6) as std, round(min(a), 6) as low, round(max(a), 6) as high from (select request_id % 5 as fold, avg(case when predicted = label then 1.0 else 0 end) as a from (" + _SQL["h14_neighbour_vote"] + ") join embeddings on vec_id = request_id group by 1)")
def _(lib):
    """Five folds: how often the vote of the nearest in the other folds is right."""
    fold = F.pmod("vec_id", F.lit(5))
    near = retrieval.best_products(_units(lib, "track_id", fold), _units(lib, "request_id", fold), 15, apart=True)
    votes = near.join(_vectors(lib).select(F.col("vec_id").alias("track_id"), "label"), "track_id")
    predicted = profile.mode_of(votes, "request_id", "label").select(F.col("request_id").alias("vec_id"), F.col("label").alias("predicted"))
    right = predicted.join(_vectors(lib).select("vec_id", "label"), "vec_id").groupBy(F.pmod("vec_id", F.lit(5)).alias("fold")).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return right.agg(r(F.avg("a"), "mean"), r(F.stddev_samp("a"), "std"), r(F.min("a"), "low"), r(F.max("a"), "high"))


@query("j16_oversampled", "select label, count(*) as before, (select max(n) from (select count(*) as n from embeddings group by label)) as after from embeddings group by 1")
def _(lib):
    """Labels filled up to the size of the largest by points between a row and one of its five nearest of the same label."""
    v = _vectors(lib)
    made = learners.oversampled(v.select("vec_id", F.col("embedding").alias("v"), "label"))
    after = made.groupBy("label").agg(F.count("*").alias("after"))
    return v.groupBy("label").agg(F.count("*").alias("before")).join(after, "label")
