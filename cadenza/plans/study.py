"""Registered queries on anomalies, calibration, selection of features and settings, graph clusters, and the classifiers of playlists."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters, concordance, engine, graph, isolation, matrix, pairs, recommend, rerank, retrieval, scoring, selection, studies
from ..operators.storage import cut
from ..sources.domain import AUDIO
from .extras import _units
from .models import _PROBS, _features, _probs
from .registry import _IMPUTED, _KEY_SQL, _PROFILE_SQL, _RING_SQL, _SQL, AS_OF_YEAR, SIMILARITY, _corpus, _genre, _profile, _scored, query
from .reports import _RANKS, _artist_xy, _rated

GENRES = [f"g4_{i}" for i in range(4)]


def _rows(lib):
    """The feature matrix with keys and decades, made once for all uses in a query."""
    if "_rows" not in lib.__dict__:
        lib.keep("tracks", "audio_features", "track_artists", "members")
        labels = lib.table("orders").select(F.col("o_orderkey").alias("playlist_id"), F.col("o_orderstatus").alias("label"))
        first = lib.track_artists.groupBy("track_id").agg(F.min("artist_id").alias("artist_id"))
        places = _genre(lib).join(first, "track_id", "left").join(_artist_xy(lib).toDF("artist_id", "at", "al"), "artist_id", "left")
        places = places.select("track_id", F.coalesce("at", "top").alias("top"), F.coalesce("al", "left").alias("left"))
        vectors = lib.table("embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").cast("array<double>").alias("vector"))
        rows = _profile(lib).withColumn("year", S.year_of(F.col("release_date")))
        made = matrix.feature_matrix(rows, lib.track_artists, lib.playlist_tracks, labels, lib.members, lib.audio_features, places, vectors, AS_OF_YEAR, 64)
        made = made.withColumn("key_mode", S.key_mode(F.col("key"), F.col("mode"))).withColumn("decade", S.decade_of(F.col("year")))
        lib.__dict__["_rows"] = cut(made.select("track_id", "track_name", "key_mode", "decade", "gen_4", "playlist_diversity", "duration_ms_normalized", *rerank.SIMILARITY))
    return lib.__dict__["_rows"]


def _matrix(lib):
    """The same with cluster_id, cluster_prob and probs by a mixture that is fitted on it."""
    if "_matrix" not in lib.__dict__:
        vectors = matrix.mixture_vectors(_rows(lib), rerank.DECADES).select("track_id", array_to_vector("vector").alias("features"))
        soft = clusters.soft_clusters(vectors, starts=1).select("track_id", "cluster_id", "cluster_prob", "probs")
        lib.__dict__["_matrix"] = cut(_rows(lib).join(soft, "track_id"))
    return lib.__dict__["_matrix"]


def _pairs(lib):
    """All playlists that get a classifier with all tracks, as the classifiers see them, split 70 to 30 in each playlist and label."""
    return pairs.Pairs(lib.members, _matrix(lib), GENRES)


_FIGURES = "n long, " + ", ".join(f"{c} double" for c in scoring.MEASURED[1:])


# the feature matrix whole: vectors of the mixture and of the classifiers

_MATRIX = (
    f"{_PROFILE_SQL}, {_IMPUTED}, mx as (select i.track_id, " + ", ".join(f"i.{c}" for c in AUDIO) + ", i.popularity, coalesce(f4.top, 0.0) as top, coalesce(f4.\"left\", 0.0) as \"left\", i.fave_score, f2.n_playlists, f2.playlist_diversity, f3.year_normalized, f3.duration_ms_normalized, "
    f"{_KEY_SQL} as key_mode, (try_cast(substr(p.release_date, 1, 4) as integer) // 10 * 10) || 's' as decade, p.gen_4 "
    f"from imputed i join profile p using (track_id) join ({_SQL['f02_collaborative']}) f2 using (track_id) join ({_SQL['f03_temporal']}) f3 using (track_id) left join ({_SQL['f04_artist_coordinates']}) f4 using (track_id))"
)
_MIXED = [*(f'coalesce("{c}", 0.0)' for c in matrix.CLUSTER_FEATURES), *(f"case when key_mode = '{k}' then 1.0 else 0.0 end" for k in matrix.KEY_MODES), *(f"case when decade = '{d}' then 1.0 else 0.0 end" for d in rerank.DECADES)]
_PRINTED = lambda items: "array_to_string(list_transform([" + ", ".join(items) + "], lambda x: printf('%.3f', round(x, 3))), ' ')"


def _printed(column):
    return F.array_join(F.transform(column, lambda x: F.format_string("%.3f", S.rounded(x, 3))), " ").alias("vector")


@query("f09_cluster_vectors", "select track_id, " + _PRINTED([f"case when max(e{i}) over () > min(e{i}) over () then (e{i} - min(e{i}) over ()) / (max(e{i}) over () - min(e{i}) over ()) else 0 end" for i in range(len(_MIXED))]) + " as vector from ex",
       _MATRIX + ", ex as (select track_id, " + ", ".join(f"{e} as e{i}" for i, e in enumerate(_MIXED)) + " from mx)")
def _(lib):
    return matrix.mixture_vectors(_rows(lib), rerank.DECADES).select("track_id", _printed("vector"))


_SIGNALS = (
    f"{_MATRIX}, {_PROBS}, rw as (select mx.*, coalesce(best.cluster_prob, 0.0) as cluster_prob from mx left join best on vec_id = track_id), "
    "held as (select m.playlist_id, rw.* from members m join rw using (track_id)), "
    "mid as (select playlist_id, " + ", ".join(f'avg(coalesce("{c}", 0.0)) as "m_{c}"' for c in rerank.SIMILARITY) + " from held group by 1), "
    "modal as (select playlist_id, key_mode as modal_key from (select playlist_id, key_mode, row_number() over (partition by playlist_id order by count(*) desc, key_mode) as k from held where key_mode <> '' group by 1, 2) where k = 1), "
    f"ring as (select h.*, mid.* exclude (playlist_id), {_RING_SQL % 'key_mode'} as ra, {_RING_SQL % 'modal_key'} as rb from held h join mid using (playlist_id) left join modal using (playlist_id)), "
    "sig as (select *, greatest(0.0, least(1.0, coalesce((" + " + ".join(f'coalesce("{c}", 0.0) * "m_{c}"' for c in rerank.SIMILARITY) + ") / nullif(sqrt(" + " + ".join(f'coalesce("{c}", 0.0) ** 2' for c in rerank.SIMILARITY) + ") * sqrt(" + " + ".join(f'"m_{c}" ** 2' for c in rerank.SIMILARITY)
    + "), 0), 0))) as similarity_score, coalesce(least(abs(ra - rb), 24 - abs(ra - rb), 6), 6) as key_distance, abs(coalesce(tempo, 0.0) - m_tempo) as tempo_deviation from ring)"
)


def _signals(lib):
    """Members as their playlists' classifiers see them; cluster probabilities as they are given for the vectors."""
    given = _probs(lib).select(F.col("vec_id").alias("track_id"), "cluster_prob")
    rows = cut(_rows(lib).join(given, "track_id", "left"))
    return rerank.with_signals(lib.members, rows, rerank.playlist_profiles(lib.members, rows))


@query("f12_retrieval_signals", "select playlist_id, track_id, round(similarity_score, 5) as similarity_score, round(cluster_prob, 6) as cluster_prob, cast(key_distance as double) as key_distance, round(tempo_deviation, 4) as tempo_deviation from sig", _SIGNALS)
def _(lib):
    return _signals(lib).select("playlist_id", "track_id", F.round("similarity_score", 5).alias("similarity_score"), F.round("cluster_prob", 6).alias("cluster_prob"), "key_distance", F.round("tempo_deviation", 4).alias("tempo_deviation"))


_SEEN = [*(f'coalesce("{c}", 0.0)' for c in rerank.SIMILARITY), "similarity_score", "cluster_prob", "key_distance", "tempo_deviation", "0.0", "playlist_diversity", *(f"case when decade = '{d}' then 1.0 else 0.0 end" for d in rerank.DECADES), *(f"case when gen_4 = '{g}' then 1.0 else 0.0 end" for g in GENRES)]


@query("f10_rerank_vectors", "select playlist_id, track_id, array_to_string(list_transform([" + ", ".join(_SEEN[:9]) + "], lambda x: printf('%.7f', x)), ' ') as audio, " + _PRINTED(_SEEN[9:]) + " as vector from sig", _SIGNALS)
def _(lib):
    made = rerank.vectors(_signals(lib), GENRES)
    audio = F.array_join(F.transform(F.slice("features", 1, 9), lambda x: F.format_string("%.7f", x)), " ").alias("audio")
    return made.select("playlist_id", "track_id", audio, _printed(F.slice("features", 10, 24)))


# classifiers of playlists

@query("j01_playlist_classifiers")
def _(lib):
    """Boosted trees for each playlist, fitted on 70 of 100 tracks; how well each ranks the others."""
    return _learners_measured(lib, ["boosted"]).select("playlist_id", *scoring.MEASURED)


def _learners_measured(lib, kinds):
    every = _pairs(lib)
    weights = every.regressions(len(rerank.names(GENRES)))[0] if "logistic" in kinds else None
    found = every.task(lambda rows: studies.learners_measured(rows, kinds), f"model string, {_FIGURES}", ids=True, weights=weights)
    return cut(found).select("playlist_id", "model", *scoring.MEASURED)


@query("j07_learners")
def _(lib):
    """Five learners for each playlist, on held-out tracks."""
    return _learners_measured(lib, selection.LEARNERS)


@query("j09_learner_duel")
def _(lib):
    """A regression against a tree over the playlists that both serve, metric by metric."""
    return scoring.compare(_learners_measured(lib, ["logistic", "tree"]), "playlist_id", "model", "logistic", "tree", ["accuracy", "f1", "roc_auc", "brier", "log_loss"])


@query("j10_learner_metrics")
def _(lib):
    """How the metrics of two learners go together over their playlists."""
    pair = lambda a, b: F.round(F.corr(a, b), 4).alias(f"{a}_{b}")
    m = _learners_measured(lib, ["logistic", "tree"])
    return m.groupBy("model").agg(F.count("*").alias("playlists"), pair("roc_auc", "f1"), pair("roc_auc", "brier"), pair("f1", "brier"), pair("brier", "log_loss")).filter("playlists >= 3")


@query("j13_importances")
def _(lib):
    """The 15 features that weigh most in each tree learner, the mean over playlists."""
    columns = rerank.names(GENRES)
    each = _pairs(lib).task(lambda rows: studies.shares(rows, ["tree", "forest"], columns), "learner string, feature string, weight double")
    found = each.groupBy("learner", "feature").agg(F.count("*").alias("groups"), F.avg("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("weight"), "feature"))
    return found.withColumn("place", place).filter("place <= 15").select("learner", "place", "feature", "groups", F.round("weight", 6).alias("weight"))


# the mixture at work, and the engine

@query("h02_mixture")
def _(lib):
    """Memberships of all tracks in the fitted mixture."""
    total = F.aggregate("probs", F.lit(0.0), lambda s, x: s + x)
    return _matrix(lib).select("track_id", "cluster_id", F.round("cluster_prob", 6).alias("cluster_prob"), F.round(total, 6).alias("total"))


@query("h05_mixture_profile")
def _(lib):
    return clusters.cluster_profile(_matrix(lib))


@query("h16_mixture_contingency")
def _(lib):
    return _matrix(lib).groupBy("gen_4", "cluster_id").agg(F.count("*").alias("n"))


@query("i09_engine")
def _(lib):
    """Requests of all four kinds, some for a playlist's classifier, some that can't be served, through the whole engine."""
    rows, t = _matrix(lib), F.col("track_id")
    text = lambda c: F.col(c).cast("string").alias("seed_id")
    target = lib.members.agg(F.min("playlist_id").alias("target")).withColumn("one", F.lit(1))
    asked = lib.tracks.filter("track_id % 100 = 0").select(F.concat(F.lit("t"), t.cast("string")).alias("request_id"), F.lit("track").alias("request_type"), text("track_id"), F.when(t % 500 == 0, 0).otherwise(5).alias("k"), (t % 200 == 0).alias("aimed"))
    artists = lib.artists.filter("artist_id % 100 = 0").select(F.concat(F.lit("a"), F.col("artist_id").cast("string")).alias("request_id"), F.lit("artist").alias("request_type"), text("artist_id"), F.lit(5).alias("k"), F.lit(False).alias("aimed"))
    lists = lib.members.select("playlist_id").distinct().select(F.concat(F.lit("p"), "playlist_id").alias("request_id"), F.lit("playlist").alias("request_type"), F.col("playlist_id").alias("seed_id"), F.lit(10).alias("k"), F.lit(True).alias("aimed"))
    named = lib.table("part").select("p_brand").distinct().select(F.concat(F.lit("g"), "p_brand").alias("request_id"), F.lit("genre").alias("request_type"), F.col("p_brand").alias("seed_id"), F.lit(5).alias("k"), F.lit(False).alias("aimed"))
    every = asked.unionByName(artists).unionByName(lists).unionByName(named).withColumn("one", F.lit(1)).join(F.broadcast(target), "one")
    every = every.select("request_id", "request_type", "seed_id", "k", F.when(F.col("aimed"), F.when(F.col("request_type") == "playlist", F.col("seed_id")).otherwise(F.col("target"))).alias("target"))
    models = cut(_pairs(lib).task(lambda rows: studies.classifier(rows, 60), "n long, model binary").select("playlist_id", "model"))
    found = engine.answered(every, rows, lib.track_artists, lib.members, lib.genre_xy, GENRES, models)
    return found.withColumn("score", F.round("score", 6))


@query("i06_marginal_relevance")
def _(lib):
    """Of the 100 tracks most similar to each seed, the 10 that are similar to it and least like each other."""
    corpus = _corpus(lib)
    pool = cut(_scored(lib, 100).select("request_id", "track_id", "score"))
    picked = recommend.marginal_relevance(pool.join(corpus.select("track_id", *SIMILARITY), "track_id"), SIMILARITY, 10)
    return picked.join(pool, ["request_id", "track_id"]).select("request_id", "pick", "track_id", F.round("score", 6).alias("score"))


# anomalies, rankings, selection

@query("h15_anomalies")
def _(lib):
    """Tracks that a few random cuts set apart, 5 in 100 of all."""
    rows = clusters.scaled_vectors(_corpus(lib).select("track_id", *AUDIO), AUDIO)
    found = isolation.anomalies(rows.select("track_id", vector_to_array("features").alias("features")), "track_id")
    return found.select("track_id", F.round("decision", 9).alias("decision"), "is_anomaly")


@query("j19_kendall", "select x.first_genre, any_value(c.n) as n, round(sum(sign(x.popularity - y.popularity) * sign(x.tempo - y.tempo)) / nullif(sqrt(sum(abs(sign(x.popularity - y.popularity))) * sum(abs(sign(x.tempo - y.tempo)))), 0), 6) as kendall from ranks x join ranks y on x.first_genre = y.first_genre and x.track_id < y.track_id join (select first_genre, count(*) as n from ranks group by 1) c on c.first_genre = x.first_genre group by 1", _RANKS)
def _(lib):
    return concordance.kendall(_rated(lib), "first_genre", "popularity", "tempo")


@query("j02_calibration")
def _(lib):
    """Brier score of each playlist's held-out tracks before and after calibration."""
    found = _pairs(lib).task(studies.calibrated, "brier_plain double, brier_calibrated double")
    return found.select("playlist_id", "brier_plain", "brier_calibrated")


@query("j14_elimination")
def _(lib):
    """Which 5 features stay, by three kinds of models, for every playlist; and how far the models agree."""
    columns = rerank.names(GENRES)[: len(rerank.SIMILARITY)]
    every, keep = _pairs(lib), 5
    dropped = every.regressions(len(columns), keep)[1]
    by_weight = lib.spark.createDataFrame([(g, "logistic", c, int(r)) for g, rank in dropped.items() for c, r in zip(columns, rank, strict=True)], "playlist_id string, model string, feature string, rank long")
    by_trees = every.task(lambda rows: studies.eliminated(rows, ["tree", "forest"], columns, keep), "model string, feature string, rank long")
    ranks = cut(by_weight.unionByName(by_trees))
    return ranks.join(selection.agreement(ranks), ["playlist_id", "feature"]).select("playlist_id", "model", "feature", "rank", "models", "agreement")


@query("j17_grid")
def _(lib):
    """The best settings by three folds for the playlist that comes first, the one that is looked at in depth."""
    first = lib.members.agg(F.min("playlist_id")).first()[0]
    scores = _pairs(lib).task(studies.tried, "model string, setting string, auc double", only=[first], times=len(selection.grid_jobs()) * pairs.FOLDS)
    means = scores.groupBy("playlist_id", "model", "setting").agg(F.avg(F.nullif(F.col("auc"), F.lit(float("nan")))).alias("roc_auc"))
    return selection.best_settings(means).select("playlist_id", "model", "setting", F.round("roc_auc", 4).alias("roc_auc"))


@query("j20_permutation")
def _(lib):
    """What each feature is worth to the playlists' classifiers on held-out tracks, the mean over playlists."""
    columns = rerank.names(GENRES)
    found = _pairs(lib).task(lambda rows: studies.permuted(rows, columns, 60), "feature string, importance double")
    return found.groupBy("feature").agg(F.count("importance").alias("playlists"), F.round(F.avg("importance"), 6).alias("importance"))


@query("h11_graph_clusters")
def _(lib):
    """Six clusters of the graph of each vector's 10 nearest."""
    near = retrieval.best_products(_units(lib, "track_id", F.lit(0)), _units(lib, "request_id", F.lit(0)), 11)
    found = graph.graph_clusters(graph.neighbour_edges(cut(near.select("request_id", "track_id", "score"))))
    return found.select(F.col("id").alias("vec_id"), "cluster_id")


@query("h08_best_k")
def _(lib):
    """The number of clusters from 2 to 12 with the largest silhouette."""
    return clusters.best_k(clusters.sweep(lib.spark, _features(lib).select("features"), [*range(2, 13)], kinds=("kmeans",)))


@query("h10_hierarchical")
def _(lib):
    return clusters.hierarchical(_features(lib)).select("track_id", "cluster_id")
