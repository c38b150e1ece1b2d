import json

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import clusters, learners, merge, questions, recommend, reports, scoring
from cadenza.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_metrics_of_one_class_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 0, 0.9, 2), ("a", 0, 0.1, 3), ("b", 1, 0.2, 4)], "g string, label int, score double, item long")
    a, b = scoring.metrics(df, ["g"]).orderBy("g").collect()
    assert (a["roc_auc"], a["precision"], a["recall"], a["accuracy"]) == (0.75, 0.5, 1.0, 0.666667)
    assert b["roc_auc"] is None and b["precision"] == 0 and b["f1"] == 0


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    got = {r["label"]: r["n"] for r in scoring.stratified_split(df, "label", "id").filter("is_train").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 630, 1: 70}
    assert rows(scoring.stratified_split(df, "label", "id")) == rows(scoring.stratified_split(df.repartition(7), "label", "id"))


def test_regressions_and_tools(spark):
    was = spark.createDataFrame([("x", 0.9, 0.8), ("y", 0.5, 0.5)], "k string, m double, n double")
    now = spark.createDataFrame([("x", 0.8, 0.78)], "k string, m double, n double")
    assert [(r["k"], r["metric"], r["reason"]) for r in scoring.regressions(was, now, "k", ["m", "n"]).orderBy("k", "metric").collect()] == [("x", "m", "dropped"), ("y", "m", "missing"), ("y", "n", "missing")]
    used = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, [], []), (3, [], ["a"])], "key int, expected array<string>, actual array<string>")
    assert rows(scoring.tool_scores(used)) == [(1, False, 0.5), (2, True, 1.0), (3, False, 0.0)]


def test_marginal_relevance_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    x, score = rng.random((30, 4)), rng.random(30)
    df = spark.createDataFrame([(1, i, float(s), *map(float, v)) for i, (s, v) in enumerate(zip(score, x))], "request_id int, track_id long, score double, a double, b double, c double, d double")
    got = [r["track_id"] for r in recommend.marginal_relevance(df, list("abcd"), 6).orderBy("pick").collect()]
    cosine = lambda i, j: x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])
    want = [int(np.argmax(score))]
    while len(want) < 6:
        want.append(max((i for i in range(30) if i not in want), key=lambda i: 0.7 * score[i] - 0.3 * max(cosine(i, j) for j in want)))
    assert got == want
    assert rows(recommend.marginal_relevance(df.limit(2), list("abcd"), 6).select("pick")) == [(1,), (2,)]


def test_questions(spark):
    texts = ["who is Aphex Twin and what is ambient techno?", "compare a? Now the second one here?", "find a chill 90s track for a workout", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", questions.parts(F.col("t")), questions.complexity(F.col("t")), questions.expanded(F.col("t"))).orderBy("i").collect()
    assert got[0][1] == ["who is Aphex Twin", "what is ambient techno?"] and got[0][2] == "moderate"
    assert got[1][1] == ["Now the second one here?"] or len(got[1][1]) == 1
    assert got[2][3].endswith(" song tune") and got[3][1] == [""]
    assert df.select(questions.numbered_lines(F.lit("1. one\n2) two\nthree"))).first()[0] == ["one", "two"]


def test_plans_of_a_sync(spark):
    now = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "playlist_id string, n long")
    was = spark.createDataFrame([("a", 2, "active", 48.0), ("b", 1, "active", 1.0), ("d", 1, "active", 48.0)], "playlist_id string, n long, status string, hours double")
    assert rows(merge.sync_plan(now, was)) == [("a", "active", "stale", True), ("b", "active", "stale", False), ("c", "excluded", "new", False), ("d", "active", "archived", False)]
    assert rows(merge.within_budget(now, "n", "playlist_id", 3)) == [("b", 2), ("c", 1)]


def test_histogram_and_outliers(spark):
    df = spark.createDataFrame([("g", float(v), 5.0) for v in range(11)], "g string, x double, y double")
    assert sum(r["n"] for r in reports.histogram(df, ["x"], 5).collect()) == 11
    assert rows(reports.histogram(df, ["y"], 5)) == [("y", 0, 11)]
    assert reports.centroid_outliers(df, "g", ["x", "y"]).filter("is_outlier").count() == 0


def test_clusters_and_vectors(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(i % 2 * 9 + rng.random()), float(rng.random())) for i in range(60)], "track_id long, a double, b double")
    soft = clusters.soft_clusters(clusters.scaled_vectors(df, ["a", "b"]), 2).collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in soft)
    assert len({(r["track_id"] % 2, r["cluster_id"]) for r in soft}) == 2
    members = spark.createDataFrame([(p, t) for p in range(4) for t in range(30)], "playlist_id int, track_id long")
    assert learners.track_vectors(members, 8, rounds=1, longest=10).count() == 30


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"ts": "2024", "master_metadata_track_name": "x"}, {"ts": "2025", "ms_played": 5}]))
    (tmp_path / "b.json").write_text(json.dumps({"ts": "2026", "skipped": True}))
    got = files.play_history(spark, str(tmp_path)).orderBy("ts").select("track_name", "ms_played", "skipped").collect()
    assert [tuple(r) for r in got] == [("x", 0, False), ("", 5, False), ("", 0, True)]
    (tmp_path / "a.csv").write_text("id,n\n1,NA\n")
    (tmp_path / "b.csv").write_text("n,id,m\n3,2,z\n")
    assert {r["id"]: (r["n"], r["m"]) for r in files.csv_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()} == {"1": (None, None), "2": ("3", "z")}


def test_quantiles_from_counts_equal_those_of_rows(spark):
    from cadenza.operators import quantiles

    data = [(g, float(v)) for g, values in (("a", [5, 1, 1, 2, 5, 9, 9, 9]), ("b", [3]), ("c", [7, 7, 2]), (None, [1, 4])) for v in values]
    df, shares = spark.createDataFrame(data, "g string, v double"), [0.0, 0.25, 0.5, 0.75, 1.0]
    counted = quantiles.counted_quantiles(df.groupBy("g", "v").count().withColumnRenamed("count", "n"), "v", shares, ["g"]).collect()
    plain = {r["g"]: r["q"] for r in quantiles.quantiles(df, ["v"], shares, ["g"]).collect()}
    assert {r["g"]: r["q"] for r in counted} == plain and {r["g"]: r["n"] for r in counted} == {"a": 8, "b": 1, "c": 3, None: 2}


def test_outliers_leave_their_columns_behind(spark):
    from cadenza.operators import reports

    df = spark.createDataFrame([("a", i, float(i % 7), 1.0) for i in range(40)] + [("a", 40, 900.0, None), ("b", 1, 2.0, 2.0)], "g string, track_id long, x double, y double")
    found = reports.centroid_outliers(df, "g", ["x", "y"])
    assert found.columns == ["g", "track_id", "distance", "is_outlier"] and found.count() == 42
    assert {r["track_id"] for r in found.filter("is_outlier and distance > 5").collect()} == {40}
