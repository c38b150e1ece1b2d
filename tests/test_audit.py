"""Audits, samples and answer checks on small tables."""

from pyspark.sql import functions as F

from cadenza.operators import answers, audit


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_known_ranks_count_ties_alike(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([5.0, 5.0, 3.0, 1.0])], "g string, id int, v double")
    ranked = audit.ranked_by_value(df, "g", "v")
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {0: 1, 1: 1, 2: 3, 3: 4}
    got = audit.known_ranks(ranked, spark.createDataFrame([(1,), (3,), (3,), (9,)], "id int"), "g", "id", (1, 3)).first()
    assert tuple(got) == ("g", 2, 2.5, 2.5, 1, 4, 1, 1)


def test_labelled_keeps_all_positives_and_the_same_negatives(spark):
    df, good = spark.range(200), spark.range(30)
    got = audit.labelled(df, good, "id", 20)
    assert {r["label"]: r["n"] for r in got.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 20, 1: 30}
    assert rows(got) == rows(audit.labelled(df.repartition(5), good, "id", 20))
    assert audit.labelled(df.limit(0), good, "id").count() == 0


def test_recommendations_for_playlists_leave_members_out(spark):
    corpus = spark.createDataFrame([(i, float(i), 1.0) for i in range(8)], "track_id long, a double, b double")
    members = spark.createDataFrame([("p", 3), ("p", 4), ("q", 7)], "request_id string, track_id long")
    got = audit.for_playlists(corpus, members, ["a", "b"], 3)
    assert [r["track_id"] for r in got.filter("request_id = 'p'").orderBy("place").collect()] == [5, 6, 7]
    assert not set(members.collect()) & set(got.select("request_id", "track_id").collect())
    assert got.groupBy("request_id").count().filter("count <> 3").isEmpty()
    assert audit.for_playlists(corpus, members.limit(0), ["a", "b"], 3).isEmpty()


def test_harmonic_profile(spark):
    df = spark.createDataFrame([("p", "C Minor"), ("p", "C Minor"), ("p", "G Minor"), ("p", "F# Minor")], "p string, k string")
    assert tuple(audit.harmonic_profile(df, "p", "k").first()) == ("p", "C Minor", 1.75, 2, 1, 0, 0, 0, 0, 1)


def test_side_by_side_and_failures(spark):
    a = spark.createDataFrame([("g", 1, 7), ("g", 2, 8)], "g string, place int, t int")
    b = spark.createDataFrame([("g", 1, 8)], "g string, place int, t int")
    assert rows(audit.side_by_side(a, b, "g", "t")) == [("g", 1, 7, 8), ("g", 2, 8, None)]
    top = spark.createDataFrame([("g", 1, 4.0), ("g", 2, 2.0), ("h", 3, 1.0)], "g string, t int, v double")
    assert rows(audit.failures(top, spark.createDataFrame([(1,)], "t int"), "g", "t", "v")) == [("g", 1, 2.0, -2.0), ("h", 1, 1.0, None)]


def test_answer_check(spark):
    df = spark.createDataFrame(
        [
            (1, "tell me about zouk music", "Zouk music comes from the Antilles, see there", "zouk antilles caribbean"),
            (2, "tell me about zouk", "no", None),
            (3, None, None, None),
            (4, "who is it", "a long answer without any of those words", "something else entirely"),
        ],
        "id int, question string, answer string, tools string",
    )
    got = {r["id"]: r for r in answers.answer_check(df).collect()}
    assert (got[1]["relevance"], got[1]["faithfulness"], got[1]["is_correct"], got[1]["reason"]) == (0.5, 0.0, True, "tool output is not used")
    assert (got[2]["completeness"], got[2]["faithfulness"], got[2]["is_correct"]) == (0.0, 0.5, False)
    assert got[2]["reason"] == "answer too short; question's words are missing"
    assert (got[3]["relevance"], got[3]["score"], got[3]["is_correct"]) == (1.0, 0.5, False)
    assert got[4]["relevance"] == 1.0 and got[4]["is_correct"]


def test_flags_tiers_and_verdicts(spark):
    df = spark.createDataFrame([(1, " ", 0.9), (2, "Not found", 0.1), (3, None, None), (4, "fine", 0.4)], "id int, text string, sure double")
    assert rows(df.select("id", answers.output_flags(F.col("text"), F.col("sure")))) == [(1, ["empty"]), (2, ["error", "unsure"]), (3, ["empty"]), (4, [])]
    tiers = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", "medium"), ("b", "low")], "k string, t string")
    assert rows(answers.best_tier(tiers, "k", "t")) == [("a", "high"), ("b", "medium")]
    log = spark.createDataFrame([(True, 0.1, 5), (False, 0.5, 5), (False, 0.4, 1), (False, 0.4, 2)], "c boolean, s double, n int")
    assert [r[0] for r in log.select(answers.verdict(F.col("c"), F.col("s"), F.col("n"))).collect()] == ["accept", "accept", "retry", "stop"]
    seen = spark.createDataFrame([(1, "b", 3), (1, "a", 2), (1, "b", 1), (1, None, 0)], "u int, k string, at int")
    assert rows(answers.ordered_without_repeats(seen, "u", "k", "at")) == [(1, ["b", "a"])]
