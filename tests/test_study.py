"""Exact quantiles, anomalies, rank correlation, calibration, elimination, grids, permuted columns and graph clusters against plain loops."""

import pickle

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars
from cadenza.operators import calibration, clusters, concordance, features, graph, isolation, learners, profile, quantiles, recommend, rerank, retrieval, selection


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SHARES = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize(("few", "accuracy"), [(1 << 16, 10_000), (20, 50), (3, 10)])
def test_quantiles_of_large_groups(spark, few, accuracy):
    rng = np.random.default_rng(1)
    groups = {"even": np.arange(400.0), "ties": rng.integers(0, 3, 500).astype(float), "same": np.full(300, 7.0), "wide": 10.0 ** rng.uniform(-200, 200, 300) * rng.choice([-1, 1], 300), "small": np.array([3.0, 1.0]), None: rng.random(200)}
    data = [(g, float(v), None if i % 3 else float(-v)) for g, values in groups.items() for i, v in enumerate(values)] + [("none", None, None)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(5)
    got = {(r["g"], r["feature"]): r["q"] for r in quantiles.quantiles(df, ["x", "y"], SHARES, ["g"], few, accuracy).collect()}
    for g in [*groups, "none"]:
        for c, i in (("x", 1), ("y", 2)):
            values = [r[i] for r in data if r[0] == g and r[i] is not None]
            assert got[g, c] == (pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12, abs=0) if values else None), (g, c)
    assert len(got) == 14
    flat = quantiles.quantiles(df, ["x"], [0.5], None, few, accuracy).first()["q"]
    assert flat == pytest.approx([np.median([r[1] for r in data if r[1] is not None])])
    assert quantiles.quantiles(df.limit(0), ["x"], [0.5], ["g"], few).count() == 0


def test_medians_by_narrowing_equal_sparks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"g{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)).round(2))], "g string, a double, b double")
    plain = df.groupBy("g").agg(F.median("a").alias("a"), F.median("b").alias("b"))
    monkeypatch.setattr(quantiles, "FEW", 50)
    assert rows(quantiles.medians(df, ["a", "b"], ["g"], few=50)) == rows(plain) == rows(profile.medians(df, ["g"], ["a", "b"]))
    assert rows(features.overall_medians(df.limit(0), ["a", "b"])) == [(0.0, 0.0)]


def test_anomalies_equal_a_plain_forest(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (500, 3)), [[9, 9, 9], [-8, 8, 0]], np.zeros((3, 3))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(4)
    model = isolation.forest(df, "id", trees=20, size=64)
    held = {r["tree"]: (r["rows"], pickle.loads(r["model"])) for r in model.collect()}
    assert set(held) == set(range(20)) and all(30 < n < 110 for n, _ in held.values())

    def depth(tree, v):
        feature, cut, left, end = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] + (v[feature[at]] >= cut[at])
        return end[at]

    typical = np.mean([isolation.expected_depth(n) for n, _ in held.values()])
    want = {i: 2 ** (-np.mean([depth(t, v) for _, t in held.values()]) / typical) for i, v in enumerate(x)}
    got = {r["id"]: r["score"] for r in isolation.isolation_scores(df, "id", model).collect()}
    assert got == pytest.approx(want)
    found = {r["id"]: r for r in isolation.anomalies(df, "id", trees=20, size=64).collect()}
    limit = np.quantile([-s for s in want.values()], 0.05)
    assert {i: r["decision"] for i, r in found.items()} == pytest.approx({i: -s - limit for i, s in want.items()})
    assert sum(r["is_anomaly"] for r in found.values()) == 26 and found[500]["is_anomaly"] and found[501]["is_anomaly"]
    assert rows(isolation.anomalies(df.repartition(2), "id", trees=20, size=64)) == rows(isolation.anomalies(df, "id", trees=20, size=64))
    assert isolation.anomalies(df.limit(0), "id").count() == 0
    one = spark.createDataFrame([(1, [0.0])], "id long, features array<double>")
    assert rows(isolation.anomalies(one, "id", trees=3)) == [(1, 0.0, False)]


@pytest.mark.parametrize("edges", [None, 4])
def test_kendall_by_all_pairs(spark, edges):
    rng = np.random.default_rng(4)
    groups = {"a": rng.integers(0, 9, (150, 2)), "b": np.stack([np.arange(80), rng.permutation(80)], 1), "hot": np.stack([rng.integers(0, 50, 120) * (rng.random(120) < 0.3), rng.integers(0, 4, 120)], 1), "flat": np.array([[1, 1], [1, 2]]), "one": np.array([[1, 1]])}
    data = [(g, float(x), float(y)) for g, v in groups.items() for x, y in v] + [("a", None, 1.0), ("void", None, None)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(3)
    got = {r["g"]: (r["n"], r["kendall"]) for r in concordance.kendall(df, "g", "x", "y", edges).collect()}
    for g, v in groups.items():
        s = [np.sign(v[:, None, c] - v[None, :, c]) for c in (0, 1)]
        scale = np.sqrt(np.abs(s[0]).sum() * np.abs(s[1]).sum())
        assert got[g][0] == len(v) and got[g][1] == (pytest.approx((s[0] * s[1]).sum() / scale, abs=2e-6) if scale else None)
    assert set(got) == set(groups)
    x, y = rng.integers(0, 20, 300), rng.integers(0, 20, 300)
    assert concordance.inversions(x, y) == sum(x[i] < x[j] and y[i] > y[j] for i in range(300) for j in range(300))


def plain_isotonic(score, label):
    """The best rising fit by all means of intervals: max over starts of min over ends."""
    values = sorted(set(score))
    means = lambda a, b: np.mean([y for s, y in zip(score, label, strict=True) if values[a] <= s <= values[b]])
    return {v: max(min(means(a, b) for b in range(i, len(values))) for a in range(i + 1)) for i, v in enumerate(values)}


def test_isotonic_curves(spark):
    rng = np.random.default_rng(5)
    data = [(g, float(s), int(rng.random() < s**2)) for g in "ab" for s in rng.random(60).round(2)] + [("c", 0.5, 1), ("c", 0.5, 0)]
    df = spark.createDataFrame(data, "g string, score double, label int").repartition(4)
    for r in calibration.isotonic(df, "g").collect():
        mine = [(s, y) for g, s, y in data if g == r["g"]]
        want = plain_isotonic(*zip(*mine, strict=True))
        assert np.interp(list(want), r["xs"], r["ys"]) == pytest.approx(list(want.values()))
        assert (np.diff(r["xs"]) > 0).all() and (np.diff(r["ys"]) >= 0).all()
    blocks = np.array([[s, 1, i, i] for i, s in enumerate(rng.integers(0, 2, 40).tolist())], float)
    parts = np.concatenate([calibration.pooled(blocks[:13]), calibration.pooled(blocks[13:])])
    assert calibration.pooled(parts).tolist() == calibration.pooled(blocks).tolist()


@pytest.fixture(scope="module")
def labelled(spark):
    """Group p follows the first column, q the second and third; r has one class only in the end."""
    rng = np.random.default_rng(6)
    x = rng.random((300, 6)).round(3)
    data = [(g, i, int((v[0] if g == "p" else (v[1] + v[2]) / 2) + rng.normal(0, 0.1) > 0.6), v.tolist()) for g in "pq" for i, v in enumerate(x)] + [("r", i, 1, x[i].tolist()) for i in range(30)]
    return spark.createDataFrame(data, "playlist_id string, track_id long, label int, features array<double>").repartition(3)


def test_calibrated_groups(spark, labelled):
    models = calibration.calibrated_groups(labelled, rounds=40)
    assert {r["playlist_id"] for r in models.collect()} == {"p", "q"}
    scored = learners.score_groups(labelled, models)
    off = scored.groupBy("playlist_id").agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"), F.max("score").alias("hi"), F.min("score").alias("lo")).collect()
    assert len(off) == 2 and all(r["brier"] < 0.15 and r["lo"] >= 0 and r["hi"] <= 1 for r in off)
    r = models.filter("playlist_id = 'p'").first()
    held, x = pickle.loads(r["model"]), np.array(labelled.filter("playlist_id = 'p'").orderBy("track_id").first()["features"])[None]
    assert learners.probabilities(held, x) == pytest.approx(np.mean([np.interp(learners.tree_scores(t, x), a, b) for t, a, b in held], axis=0))


def test_elimination(spark, labelled):
    columns = list("abcdef")
    ranks = selection.elimination(labelled.filter("playlist_id <> 'r'"), columns, 2)
    got = {}
    for r in ranks.collect():
        got.setdefault((r["playlist_id"], r["model"]), {})[r["feature"]] = r["rank"]
    assert set(got) == {(g, m) for g in "pq" for m in selection.KINDS}
    assert all(sorted(v.values()) == [1, 1, 2, 3, 4, 5] for v in got.values())
    assert all(v["a"] == 1 for (g, _), v in got.items() if g == "p") and all(v["b"] == v["c"] == 1 for (g, _), v in got.items() if g == "q")
    verdicts = {r[:2]: r[3] for r in rows(selection.agreement(ranks))}
    assert verdicts["q", "b"] == "unanimous" and verdicts["q", "f"] == "never"


def test_histograms_kept_at_the_root_change_nothing():
    rng = np.random.default_rng(7)
    x, y = rng.random((200, 4)), rng.integers(0, 2, 200).astype(float)
    b = selection.Binned(x)
    root = b.histograms(np.arange(200), y)
    for columns in ([0, 1, 2, 3], [1, 3]):
        assert selection.grow_tree(b, y, np.array(columns), root=root)[0] == selection.grow_tree(b, y, np.array(columns))[0]
    tree, gains = selection.grow_tree(b, y, np.array([0, 2]), depth=2, entropy=True)
    assert gains[1] == gains[3] == 0 and gains[0] + gains[2] > 0
    f, c = tree["f"], tree["c"]
    best = min((sum(len(s) * (lambda q: 0 if q in (0, 1) else -(q * np.log2(q) + (1 - q) * np.log2(1 - q)))(s.mean()) for s in (y[b.code[j] <= k], y[b.code[j] > k]) if len(s)), j, k) for j in (0, 2) for k in range(31))
    got = sum(len(s) * -(s.mean() * np.log2(s.mean()) + (1 - s.mean()) * np.log2(1 - s.mean())) for s in (y[b.code[f] <= c], y[b.code[f] > c]))
    assert got == pytest.approx(best[0])


def test_grid(spark, labelled):
    trees = [{"max_depth": 2, "criterion": "gini", "splitter": "best"}, {"max_depth": None, "criterion": "entropy", "splitter": "random"}]
    boosted = [{"n_estimators": n, "max_depth": 2, "learning_rate": 0.1} for n in (5, 20)]
    rows_ = labelled.filter("playlist_id <> 'r'")
    got = {(r["playlist_id"], r["setting"]): r["roc_auc"] for r in selection.grid(rows_, tree_grid=trees, boosted_grid=boosted).collect()}
    assert len(got) == 8 and all(0.6 < v <= 1 for v in got.values())
    part = rows_.filter("playlist_id = 'p'").toPandas()
    part = part.assign(h=pd.util.hash_array(part["track_id"].astype(str).to_numpy(object))).sort_values(["label", "h"])
    x, y, fold = np.stack(part["features"]), part["label"].to_numpy(), part.groupby("label").cumcount().to_numpy() % 3
    for n in (5, 20):
        want = [selection.auc(y[fold == f], learners.tree_scores(learners.boosted_trees(x[fold != f], y[fold != f], n, 0.1, 2), x[fold == f])) for f in range(3)]
        assert got["p", f'{{"n_estimators": {n}, "max_depth": 2, "learning_rate": 0.1}}'] == pytest.approx(np.mean(want))
    best = {r[0]: r[3] for r in rows(selection.best_settings(selection.grid(rows_, tree_grid=[], boosted_grid=boosted)))}
    assert best["p"] == max(v for (g, s), v in got.items() if g == "p" and "n_est" in s)


def test_permuted_columns(spark, labelled, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", 100)
    made = selection.permuted(labelled, list("abcdef")).toPandas()
    assert len(made) == 7 * 630
    plain = made[made["feature"].isna()].set_index(["playlist_id", "track_id"])["features"]
    for j, c in enumerate("abcdef"):
        moved = made[made["feature"] == c].set_index(["playlist_id", "track_id"])["features"].loc[plain.index]
        a, b = np.stack(plain), np.stack(moved)
        assert (np.delete(a, j, 1) == np.delete(b, j, 1)).all() and (a[:, j] != b[:, j]).mean() > 0.9
        for g in "pqr":
            own = plain.index.get_level_values(0) == g
            assert sorted(a[own, j]) == sorted(b[own, j])
    found = {r[:2]: r[2] for r in rows(selection.permutation_importance(labelled.filter("playlist_id <> 'r'"), learners.fit_groups(labelled, rounds=40), list("abcdef")))}
    assert found["p", "a"] > 0.2 and abs(found["p", "e"]) < 0.05 and found["q", "b"] > 0.05


def test_graph_clusters(spark):
    rng = np.random.default_rng(8)
    spots = np.concatenate([rng.normal(m, 0.4, (n, 2)) for m, n in (((0, 0), 20), ((3, 0), 30), ((0, 4), 12))])
    d = ((spots[:, None] - spots[None]) ** 2).sum(2)
    near = [(i, int(j), float(np.exp(-d[i, j]))) for i in range(62) for j in np.argsort(d[i])[:8]]
    edges = graph.neighbour_edges(spark.createDataFrame(near, "request_id long, track_id long, score double"))
    w = np.zeros((62, 62))
    for i, j, s in near:
        if i != j:
            w[i, j] = w[j, i] = max(s, w[i, j])
    assert {r[:2]: r[2] for r in rows(edges)} == {(i, j): w[i, j] for i, j in np.argwhere(w > 0).tolist()}
    v = w.sum(1) / w.sum()
    for _ in range(6):
        v = (w / w.sum(1, keepdims=True)) @ v
    got = dict(rows(graph.power_iteration(edges, rounds=6, eps=0)))
    assert [got[i] * v.sum() for i in range(62)] == pytest.approx(v.tolist())
    named = {r[0]: r[2] for r in rows(graph.graph_clusters(edges, 3, rounds=30))}
    groups = [0] * 20 + [1] * 30 + [2] * 12
    best = sum(max(sum(named[i] == c for i in range(62) if groups[i] == g) for c in range(3)) for g in range(3))
    assert len(set(named.values())) == 3 and best >= 58
    assert graph.graph_clusters(edges.limit(0)).count() == 0


def test_pairs_that_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "REQUESTS", 3)
    x = np.random.default_rng(9).random((40, 3))
    df = spark.createDataFrame([(f"t{i:02d}", v.tolist(), 0) for i, v in enumerate(x)], "track_id string, v array<double>, part long").repartition(4)
    asked = df.withColumnRenamed("track_id", "request_id").limit(8)
    skip = spark.createDataFrame([(f"t{i:02d}", f"t{j:02d}") for i in range(8) for j in range(30)] + [("t99", "t01"), ("t01", "gone")], "request_id string, track_id string")
    got = {}
    for r in retrieval.best_products(df, asked, 20, without=skip).collect():
        got.setdefault(r["request_id"], []).append(r["track_id"])
    ids = [r["request_id"] for r in asked.collect()]
    for q in ids:
        assert len(got[q]) == (10 if int(q[1:]) < 8 else 20)
        assert not (int(q[1:]) < 8 and any(int(t[1:]) < 30 for t in got[q]))


def test_signals_and_vectors_of_classifiers(spark):
    base = {c: 0.0 for c in rerank.SIMILARITY} | {"tempo": 100.0, "popularity": 10.0}
    data = [(1, "C Minor", "1990s", "g", 0.7, *base.values()), (2, "G Minor", "2030s", None, 0.6, *(base | {"tempo": 130.0}).values()), (3, "", None, "h", None, *(base | {"tempo": None}).values())]
    tracks = spark.createDataFrame(data, "track_id long, key_mode string, decade string, gen_4 string, cluster_prob double, " + ", ".join(f"`{c}` double" for c in rerank.SIMILARITY))
    members = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "playlist_id string, track_id long")
    profiles = rerank.playlist_profiles(members, tracks)
    assert rows(profiles.select("playlist_id", "modal_key", "mean_tempo")) == [("p", "C Minor", 115.0), ("q", "", 0.0)]
    pairs = spark.createDataFrame([(g, t) for g in "pqz" for t in (1, 2, 3)], "playlist_id string, track_id long")
    signals = rerank.with_signals(pairs, tracks, profiles)
    got = {(r["playlist_id"], r["track_id"]): r for r in rerank.vectors(signals, ["g", "h"]).collect()}
    a = got["p", 2]
    assert (a["key_distance"], a["tempo_deviation"], a["cluster_prob"]) == (1.0, 15.0, 0.6)
    assert a["similarity_score"] == pytest.approx((130 * 115 + 100) / np.hypot(130, 10) / np.hypot(115, 10))
    assert got["z", 1]["similarity_score"] == 0 and got["p", 3]["key_distance"] == 6
    assert len(a["features"]) == len(rerank.names(["g", "h"])) == 31 and sum(a["features"][21:]) == 0 and sum(got["p", 1]["features"][21:]) == 2
    with pytest.raises(ValueError):
        rerank.vectors(signals.drop("cluster_prob"), ["g"])


def test_davies_bouldin_and_best_k(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(m, 1, (n, 2)) for m, n in ((0, 15), (5, 10), (9, 8))])
    label = [0] * 15 + [1] * 10 + [2] * 8
    df = spark.createDataFrame([(g, v.tolist()) for g, v in zip(label, x, strict=True)], "g int, v array<double>")
    c = [x[[i for i, h in enumerate(label) if h == g]].mean(0) for g in range(3)]
    s = [np.mean([np.linalg.norm(x[i] - c[g]) for i, h in enumerate(label) if h == g]) for g in range(3)]
    want = np.mean([max((s[g] + s[h]) / np.linalg.norm(c[g] - c[h]) for h in range(3) if h != g) for g in range(3)])
    assert clusters.davies_bouldin(df, "v", "g").first()[0] == pytest.approx(want, abs=1e-6)
    swept = spark.createDataFrame([("k", 2, 1.0, 0.4), ("k", 3, 1.0, 0.6), ("k", 4, 1.0, 0.6)], "algorithm string, k int, cost double, silhouette double")
    assert rows(clusters.best_k(swept)) == [("k", 3, 0.6)]


def test_dear_rows_are_made_once(spark):
    """Metrics and quantiles read their rows several times; what made them must not run again for each."""
    from cadenza.operators import scoring

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def dear(x):
        made.add(1)
        return x

    scored = spark.range(40, numPartitions=2).select(F.lit("a").alias("g"), F.col("id").alias("item"), (F.col("id") % 2).cast("int").alias("label"), dear(F.col("id") / 40).alias("score"))
    assert scoring.metrics(scored, ["g"]).first()["n"] == 40
    assert made.value == 40
    made.value = 0
    assert quantiles.quantiles(scored.select("g", "score"), ["score"], [0.5], ["g"], few=4).first()["q"] == [19.5 / 40]
    assert made.value == 40


def test_large_groups_take_one_sketch(spark, monkeypatch):
    """Ranks start from a sketch of all rows, not from the ends of the column; so one round reaches the last few rows."""
    calls, plain = [], quantiles.cut
    monkeypatch.setattr(quantiles, "cut", lambda df: calls.append(df.columns) or plain(df))
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    assert quantiles.quantiles(df, ["x"], [0.5], None, few=500).first()["q"] == [9999.5]
    assert len(calls) <= 6


def test_candidates_are_searched_once(spark, monkeypatch):
    """Marginal relevance needs its candidates twice; the search for them must not run twice."""
    seen, search = spark.sparkContext.accumulator(0), recommend.similar

    def counted(*args):
        found = search(*args).select("request_id", "track_id", "score")

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(recommend, "similar", counted)
    corpus = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(40)], "track_id long, a double, b double")
    seeds = corpus.filter("track_id < 3").withColumn("request_id", F.col("track_id"))
    assert recommend.diverse_similar(corpus, seeds, ["a", "b"], 4, 10).count() == 12
    assert seen.value == 30


def test_rounded_as_the_sql_does(spark):
    """Spark's own round gives 0.5338 for the first of these."""
    data = [0.53375, 0.2885, 1.0005, 12.34565, -0.53375, -2.00005, 0.0, 5e-05, 0.49999999999999994, 1e300, None]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    got = [r[0] for r in df.select(scalars.rounded(F.col("x"), 4)).collect()]
    assert got == duckdb.execute("select list(round(x, 4)) from (select unnest($1::double[]) as x)", [data]).fetchone()[0]
