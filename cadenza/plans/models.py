"""Registered queries on clusters, recommendations and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, learners, recommend
from ..sources.domain import AUDIO
from .registry import _IMPUTED, _PROFILE_SQL, SIMILARITY, _corpus, _genre, query


_CENTRES = "cells as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), centres as (select label, i, avg(x) as x from cells group by 1, 2)"
_PROBS = _CENTRES + ", gaps as (select c.vec_id, m.label, 1 / (sqrt(sum((c.x - m.x) ** 2)) + 1e-9) as w from cells c join centres m using (i) group by 1, 2), probs as (select vec_id, label, w / sum(w) over (partition by vec_id) as p, dense_rank() over (order by label) - 1 as cluster_id from gaps), best as (select vec_id, arg_max(cluster_id, p) as cluster_id, max(p) as cluster_prob from probs group by 1)"


def _vectors(lib):
    return lib.table("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _probs(lib):
    v = _vectors(lib)
    return clusters.inverse_distance_probs(v, clusters.label_centroids(v, "embedding", "label"), "embedding", "vec_id", "label")


@query("h03_most_likely", "select vec_id, cluster_id, round(cluster_prob, 6) as cluster_prob from best", _PROBS)
def _(lib):
    return _probs(lib).select("vec_id", "cluster_id", F.round("cluster_prob", 6).alias("cluster_prob"))


@query("h05_cluster_profile", "select cluster_id, count(*) as n, round(avg(cluster_prob), 6) as mean, round(median(cluster_prob), 6) as median, round(min(cluster_prob), 6) as low, round(max(cluster_prob), 6) as high, round(avg(case when cluster_prob < 0.5 then 1.0 else 0 end), 6) as unsure from best group by 1", _PROBS)
def _(lib):
    return clusters.cluster_profile(_probs(lib))


@query("h04_cluster_filter", "select request_id, count(*) as n from (select vec_id as request_id, cluster_id, p from probs where vec_id % 100 = 0) join best using (cluster_id) where p >= 0.1 group by 1", _PROBS)
def _(lib):
    rows = _probs(lib)
    corpus = rows.select(F.col("vec_id").alias("track_id"), "cluster_id")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("request_id"), "probs")
    return clusters.same_cluster(corpus, asked, 0.1).groupBy("request_id").agg(F.count("*").alias("n"))


@query("h12_variance_ratio", "select round(w, 4) as within, round(b, 4) as between, round((b / (k - 1)) / (w / (n - k)), 4) as ratio, (select round(avg(r), 6) from (select a.label, max((a.s + b.s) / d) as r from spread a join spread b on a.label <> b.label join (select p.label as x, q.label as y, sqrt(sum((p.x - q.x) ** 2)) as d from centres p join centres q using (i) group by 1, 2) on x = a.label and y = b.label group by 1)) as davies_bouldin from (select sum((c.x - m.x) ** 2) as w, count(distinct vec_id) as n from cells c join centres m using (label, i)), (select sum(s.n * (m.x - t.x) ** 2) as b, count(distinct label) as k from centres m join (select label, count(*) as n from embeddings group by 1) s using (label) join (select i, avg(x) as x from cells group by 1) t using (i))", _CENTRES + ", spread as (select label, avg(d) as s from (select vec_id, label, sqrt(sum((c.x - m.x) ** 2)) as d from cells c join centres m using (label, i) group by 1, 2) group by 1)")
def _(lib):
    v = _vectors(lib)
    one = clusters.variance_ratio(v, "embedding", "label").withColumn("one", F.lit(1))
    return one.join(F.broadcast(clusters.davies_bouldin(v, "embedding", "label").withColumn("one", F.lit(1))), "one").drop("one")


@query("h16_contingency", "select label, cluster_id, count(*) as n from best join embeddings using (vec_id) group by 1, 2", _PROBS)
def _(lib):
    return _probs(lib).join(_vectors(lib), "vec_id").groupBy("label", "cluster_id").agg(F.count("*").alias("n"))


@query("g05_centroid_cosines", "select a.label as a, b.label as b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) as cosine from centres a join centres b using (i) group by 1, 2", _CENTRES)
def _(lib):
    c = clusters.label_centroids(_vectors(lib), "embedding", "label")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    both = c.toDF("a", "x").join(F.broadcast(c.toDF("b", "y")))
    return both.select("a", "b", F.round(dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))), 6).alias("cosine"))


@query("g04_seed_similarity", "select e.vec_id, round(list_cosine_similarity(e.embedding::double[], s.embedding::double[]), 6) as similarity from embeddings e, (select embedding from embeddings order by vec_id limit 1) s")
def _(lib):
    v = _vectors(lib)
    seed = v.agg(F.min_by("embedding", "vec_id").alias("seed")).withColumn("one", F.lit(1))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    size = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))
    rows = v.withColumn("one", F.lit(1)).join(F.broadcast(seed), "one")
    return rows.select("vec_id", F.round(dot("embedding", "seed") / (size("embedding") * size("seed")), 6).alias("similarity"))


def _features(lib):
    return clusters.scaled_vectors(_corpus(lib).select("track_id", "first_genre", *SIMILARITY), SIMILARITY)


@query("h01_soft_clusters")
def _(lib):
    return clusters.soft_clusters(_features(lib)).select("track_id", "cluster_id", F.round("cluster_prob", 6).alias("cluster_prob"))


@query("h07_cluster_sweep")
def _(lib):
    rows = _features(lib).select("features")
    return clusters.sweep(lib.spark, rows, [*range(2, 13)], kinds=("kmeans",)).unionByName(clusters.sweep(lib.spark, rows, [4, 6, 8], kinds=("bisecting",)))


@query("h13_explained_variance")
def _(lib):
    return clusters.explained_variance(lib.spark, _features(lib).select("features"), 5)


@query("f06_track_vectors")
def _(lib):
    return learners.track_vectors(lib.members).select("track_id", F.size("vector").alias("size"))


# recommendations

@query("i01_similar_tracks")
def _(lib):
    corpus = _corpus(lib)
    seeds = corpus.filter("track_id % 100 = 0").withColumn("request_id", F.col("track_id"))
    return recommend.diverse_similar(corpus, seeds, SIMILARITY, 10)


def _artist_requests(lib):
    return lib.track_artists.select(F.col("artist_id").alias("request_id"), "track_id")


@query("i02_for_artists")
def _(lib):
    corpus = _corpus(lib)
    asked = _artist_requests(lib)
    return recommend.diverse_similar(corpus, recommend.centroids(corpus, asked, SIMILARITY), SIMILARITY, 10)


@query("i05_for_genres")
def _(lib):
    centres = lib.genre_xy.select(F.col("first_genre").alias("name"), F.col("top").alias("top0"), F.col("left").alias("left0"))
    return recommend.for_zone(_corpus(lib), centres, [c for c in SIMILARITY if c not in ("top", "left")], 10)


_COS = lambda a, b: " + ".join(f"coalesce({a}.\"{c}\", 0) * {b}.\"{c}\"" for c in SIMILARITY)


@query("g08_recall", "select a.request_id, count(*) as members, round(count(f.track_id) / count(*), 3) as recall from asked a left join (select * from (select request_id, track_id, row_number() over (partition by request_id order by score desc, track_id) as r from sims) where r <= 100) f using (request_id, track_id) group by 1",
       f"{_PROFILE_SQL}, {_IMPUTED}, asked as (select artist_id as request_id, track_id from track_artists), cent as (select request_id, " + ", ".join(f'avg(coalesce("{c}", 0)) as "{c}"' for c in SIMILARITY) + " from asked join imputed using (track_id) group by 1), "
       f"sims as (select r.request_id, c.track_id, round(greatest(0, least(1, ({_COS('c', 'r')}) / (sqrt({' + '.join(f'coalesce(c.{chr(34)}{x}{chr(34)}, 0) ** 2' for x in SIMILARITY)}) * sqrt({_COS('r', 'r')})))), 9) as score from imputed c, cent r)")
def _(lib):
    corpus, asked = _corpus(lib), _artist_requests(lib)
    found = recommend.similar(corpus, recommend.centroids(corpus, asked, SIMILARITY), SIMILARITY, 100)
    return recommend.recall(found, asked)


@query("i10_request_checks", "select event_id, case when event_type not in ('click', 'view', 'purchase') then 'type' when not item between 1 and 50 then 'k' end as problem from plays")
def _(lib):
    kind = F.create_map(*(F.lit(x) for pair in (("click", "track"), ("view", "artist"), ("purchase", "genre")) for x in pair))
    rows = lib.plays.select("event_id", F.try_element_at(kind, F.col("event_type")).alias("request_type"), F.col("item").alias("k"), F.col("user_id").alias("seed_id"))
    return recommend.validated(rows).select("event_id", "problem")
