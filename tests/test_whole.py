"""Tool output, stalls, pairs of groups that share items, lists of genres, analysis of messages on small tables."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.operators import profile, questions, validation


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_issues_of_tool_output(spark):
    data = [
        (1, "artist_info", ["twin"], ["get_artist_context"], "Aphex Twin is a musician", "high"),
        (2, "artist_info", ["twin"], ["get_artist_context"], "  ", None),
        (3, "artist_info", [], ["search_tracks"], "No results here", "low"),
        (4, "recommendation", ["chill"], ["get_related_artists", "x"], "some text", None),
        (5, "chit_chat", ["a", "some"], ["whatever"], "some text", None),
        (6, "history", None, None, None, None),
        (7, None, None, [], "Fine", "medium"),
    ]
    df = spark.createDataFrame(data, "id int, intent string, entities array<string>, tools array<string>, output string, confidence string")
    got = {r["id"]: r["issues"] for r in validation.issues(df).collect()}
    assert got == {1: [], 2: ["empty"], 3: ["error", "low confidence", "mismatch"], 4: ["missing: chill"], 5: ["missing: a"], 6: ["empty"], 7: []}


def test_stalls(spark):
    seen = [["a", "b"], ["b", "a"], ["a", "b"], ["b", "a"], ["a"], [], [], ["a"], ["a"]]
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(seen)] + [("d", 0, ["a"])], "conv string, turn int, tools array<string>").repartition(3)
    got = [(r["stall_count"], r["stalled"]) for r in validation.stalls(df, "conv", "turn").filter("conv = 'c'").orderBy("turn").collect()]
    assert got == [(0, False), (1, False), (2, False), (3, True), (0, False), (0, False), (0, False), (0, False), (1, False)]
    assert validation.stalls(df.limit(0), "conv", "turn").count() == 0


@pytest.mark.parametrize("holders", [1000, 3])
def test_shared_items_by_all_pairs(spark, holders):
    sets = {g: {i for i in range(12) if (g * 7 + i * i) % 5 < 2} | {99} for g in range(15)} | {77: {500}}
    df = spark.createDataFrame([(g, i) for g, items in sets.items() for i in items], "g int, i int").repartition(3)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {r[:2]: r[2] for r in rows(profile.shared_items(df, "g", "i", holders))} == want
    got = {r[:2]: r[2] for r in rows(profile.jaccard_matrix(df.union(df), "g", "i", holders))}
    assert got == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if sets[a] & sets[b]}


def test_genre_lists(spark):
    data = [("p", v) for v in "aaabbbccddefg"] + [("q", "z"), ("q", None), ("r", None)]
    got = {r[0]: (json.loads(r[1]), json.loads(r[2])) for r in rows(profile.genre_lists(spark.createDataFrame(data, "g string, v string"), "g", "v"))}
    order = sorted(set("abcdefg"), key=lambda v: (-Counter("aaabbbccddefg")[v], v))
    assert got == {"p": (order[:5], order[5:]), "q": (["z"], [])}


def test_analysis_switches(spark):
    df = spark.createDataFrame([("recommend a chill 90s track for a workout and tell me who is Aphex Twin really?",), ("",)], "text string")
    whole, bare = (questions.analysis(df, expand=e, find=e, split=e).filter("text <> ''").first() for e in (True, False))
    assert whole["intent"] == bare["intent"] == "artist_info" and whole["entities"]["mood"] == ["chill"] and bare["entities"]["mood"] == []
    assert len(whole["variants"]) == 2 and bare["variants"] == [bare["text"]] and bare["expanded"] == bare["text"] != whole["expanded"]
    assert (whole["level"], bare["level"]) == ("moderate", "simple")
    assert questions.analysis(df).select(F.size("variants")).collect()[1][0] == 1
