"""Sources, genre matching, vectors, neighbours, dense groups, classifiers of groups, reranking and routing on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import clusters, genres, learners, matrix, recommend, retrieval
from cadenza.sources import payloads


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_payloads_with_gaps(spark):
    text = spark.createDataFrame([('{"audio_features": [null, {"id": "a", "tempo": 120.5}, {"tempo": 1}]}',)], "value string")
    got = text.select(F.from_json("value", "audio_features array<struct<id:string,danceability:double,energy:double,loudness:double,tempo:double,time_signature:int>>").alias("x")).select("x.*")
    assert rows(payloads.feature_rows(got)) == [("a", 0.0, 0.0, 0.0, 120.5, 4.0)]
    texts = ['{"tag": {"name": "Jazz", "count": 9}}', '{"tag": [{"name": "B", "count": 5}, {"name": "c", "count": 4}, {"name": "A", "count": 7}]}', '{"tag": []}', "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in rows(df.select("i", payloads.tags_of(F.col("t"))))] == [["jazz"], ["b", "a"], [], [], []]


def test_typed_csv_cache_and_sources(spark, tmp_path):
    raw = spark.createDataFrame([("1", "NA", "x"), ("2", "3.5", "y"), ("2", "3.5", "y"), ("3", "odd", "")], "id string, n string, other string")
    raw.write.option("header", True).csv(str(tmp_path / "c"))
    assert rows(payloads.typed_csv(spark, str(tmp_path / "c"), {"id": "long", "n": "double"}, {"id": "key"}, ["", "NA", "NaN"])) == [(1, None), (2, 3.5), (3, None)]
    path = str(tmp_path / "cache")
    assert rows(payloads.cached(spark, path, lambda: raw.limit(1))) == rows(payloads.cached(spark, path, lambda: raw))
    with pytest.raises(ValueError):
        payloads.first_source([lambda: raw.limit(0), lambda: spark.read.parquet(str(tmp_path / "none"))])


def test_genre_names(spark):
    plane = spark.createDataFrame([("Deep House", 1.0, 1.0), ("House", 5.0, 1.0), ("acid house", 9.0, 9.0)], "first_genre string, top double, left double")
    names = spark.createDataFrame([("HOUSE",), ("hous",), ("deep",), ("rock",), ("",), (None,), ("a.*e",)], "name string")
    assert rows(genres.resolve(names, plane)) == [("HOUSE", "House"), ("deep", "Deep House"), ("hous", "Deep House")]


def test_vectors_and_signals(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 5.0), (2, "b", None, 5.0), (3, None, 4.0, 5.0)], "track_id long, kind string, x double, y double")
    assert rows(matrix.cluster_vectors(df, ["x", "y"], "kind", ["a", "b"])) == [(1, [0.5, 0.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0, 0.0])]
    with pytest.raises(ValueError):
        matrix.rerank_vectors(df, ["similarity"], [])
    members = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "playlist_id string, track_id long")
    got = {r[:2]: r[2] for r in rows(matrix.retrieval_signals(df, members, ["x", "y"]))}
    assert got["q", 3] == pytest.approx(1) and got["p", 2] == pytest.approx(25 / (5 * 26**0.5))


@pytest.mark.parametrize("limits", [(4096, 256), (3, 7)])
def test_best_products_by_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(retrieval, "REQUESTS", limits[0])
    monkeypatch.setattr(retrieval, "ROWS", limits[1])
    x = np.random.default_rng(1).standard_normal((60, 5)).round(1)
    x[7], x[9:12] = 0, x[12]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "track_id long, v array<double>, part long").repartition(4)
    size = np.linalg.norm(x, axis=1)
    u = np.where(size[:, None] > 0, x / np.maximum(size, 1e-30)[:, None], 0)
    s = np.round(np.clip(u @ u.T, 0, 1), 9)
    for same, apart in ((False, False), (True, False), (False, True)):
        got = {}
        for r in retrieval.best_products(df, df.withColumnRenamed("track_id", "request_id"), 4, same, apart).collect():
            got.setdefault(r["request_id"], {})[r["rank"]] = (r["track_id"], r["score"])
        for q in range(60):
            ok = [i for i in range(60) if not (same and i % 3 != q % 3) and not (apart and i % 3 == q % 3)]
            best = sorted(ok, key=lambda i: (-s[q, i], i))[:4]
            assert [got[q][k][1] for k in (1, 2, 3, 4)] == pytest.approx([s[q, i] for i in best], abs=2e-9)
    assert retrieval.best_products(df, df.withColumnRenamed("track_id", "request_id").limit(0), 4).count() == 0


def test_silhouettes_and_dense_groups(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (12, 3)), rng.normal(4, 1, (9, 3)), [[9, 9, 9]]])
    label = [0] * 12 + [1] * 9 + [2]
    df = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, g int")
    got = {r["id"]: r["silhouette"] for r in clusters.silhouettes(df, "v", "id", "g").collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i, g in enumerate(label):
        own = [j for j, h in enumerate(label) if h == g and j != i]
        b = min(np.mean([d[i, j] for j, h in enumerate(label) if h == k]) for k in {0, 1, 2} - {g})
        a = np.mean(d[i, own]) if own else None
        assert got[i] == pytest.approx((b - a) / max(a, b) if own else 0)
    spots = [(0, 0), (1, 0), (2, 0), (3, 0), (9, 9), (9.5, 9), (9, 9.5), (20, 20), (4.2, 0)]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(spots)], "id long, top double, left double")
    assert dict(rows(clusters.dense_groups(points, 1.3, 3))) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: -1, 8: 1}


def test_classifiers_of_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "track_id long, features array<double>")
    good = {"p": [i for i in range(400) if x[i, 0] > 0.8], "q": [i for i in range(400) if x[i, 1] + x[i, 2] < 0.5], "few": [1, 2, 3]}
    members = spark.createDataFrame([(g, i) for g, ids in good.items() for i in ids], "playlist_id string, track_id long")
    labelled = learners.group_labels(members, corpus).join(corpus, "track_id")
    held = {(r["playlist_id"], r["label"]): r["n"] for r in labelled.groupBy("playlist_id", "label").agg(F.count("*").alias("n")).collect()}
    assert {k[0] for k in held} == {"p", "q"} and all(held[g, 1] == len(good[g]) and held[g, 0] > len(good[g]) for g in "pq")
    asked = spark.createDataFrame([(g,) for g in good], "playlist_id string").crossJoin(corpus)
    scored = learners.score_groups(asked, learners.fit_groups(labelled)).collect()
    assert {r["playlist_id"] for r in scored} == {"p", "q"} and len(scored) == 800
    right = [(r["score"] > 0.5) == (r["track_id"] in good[r["playlist_id"]]) for r in scored]
    assert np.mean(right) > 0.95


def test_reranked_and_routed(spark):
    near = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.8), (2, 10, 0.5)], "request_id long, track_id long, score double")
    scored = spark.createDataFrame([(1, 11, 0.2), (1, 12, 0.7)], "request_id long, track_id long, score double")
    got = recommend.reranked(near, scored, ["request_id", "track_id"])
    assert rows(got.select("request_id", "place", "track_id")) == [(1, 1, 12), (1, 2, 11), (1, 3, 10), (2, 1, 10)]
    asked = spark.createDataFrame([(1, "track", 1, 5), (2, "track", 3, 6), (3, "mood", 3, 1), (4, "artist", 99, 1), (5, "artist", 2, None)], "request_id long, request_type string, k int, seed_id long")
    answers = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 8, 0.8)], "request_id long, rank int, track_id long, score double")
    out = recommend.routed(asked, {"track": lambda r: answers.join(r.select("request_id"), "request_id")})
    assert rows(out.select("request_id", "rank", "track_id", "problem")) == [(1, 1, 7, None), (2, None, None, "nothing found"), (3, None, None, "type"), (4, None, None, "k"), (5, None, None, "seed")]
