from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import convlog, features, merge, profile, retrieval


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_key_distance(spark):
    d = lambda a, b: S.key_distance(F.lit(a), F.lit(b))
    got = one(spark, d("C Minor", "G Minor"), d("C Minor", "F# Minor"), d("C Minor", "UNKNOWN"), d("C Minor", "C Minor"), d("Ab Minor", "E Major"))
    assert got == (1, 6, 6, 0, 1)


def test_tempo_compatible(spark):
    t = lambda a, b, *x: S.tempo_compatible(F.lit(a), F.lit(b), *x)
    assert one(spark, t(120.0, 124.0), t(120.0, 60.5), t(120.0, 180.0), t(120.0, 240.5), t(120.0, 124.0, 1.0)) == (True, True, False, True, False)


def test_texts(spark):
    assert one(spark, S.slug(F.lit("Lady Stardust")), S.slug(F.lit("¡Zapatos! ¡Zapatos!")), S.slug(F.lit("  spaces  "))) == ("lady_stardust", "zapatos_zapatos", "__spaces__")
    assert one(spark, S.genre_tag(F.lit("jazz, bossa nova")), S.genre_tag(F.lit("experimental noise"))) == ("bossa nova", None)
    assert one(spark, S.list_items(F.lit("['a', \"b\", ]"))) == (["a", "b"],)
    assert one(spark, S.year_of(F.lit("1973-04-01")), S.year_of(F.lit("x"))) == (1973, None)
    assert one(spark, S.key_mode(F.lit(7), F.lit(0)), S.key_mode(F.lit(-1), F.lit(0))) == ("G Minor", "")


def test_intents(spark):
    name, sure = convlog.intent(F.col("t"))
    rows = spark.createDataFrame([("asdfghjkl",), ("suggest some chill tracks for studying",), ("who is Aphex Twin?",)], "t string").select(name, sure).collect()
    assert [tuple(r) for r in rows][0] == ("artist_info", 0.3)
    assert [r[0] for r in rows][1:] == ["recommendation", "artist_info"]


def test_zone_and_retrieval(spark):
    corpus = spark.createDataFrame([("t1", 2862.0, 1004.0), ("t2", 2000.0, 1100.0), ("t3", 5000.0, 800.0), ("t4", 3000.0, 950.0), ("t5", 10000.0, 500.0)], "track_id string, top double, left double")
    centres = spark.createDataFrame([("zouk", 2862.0, 1004.0)], "name string, top0 double, left0 double")
    assert [r[0] for r in retrieval.within_radius(corpus, centres, 500.0).orderBy("enoa_distance").select("track_id").collect()] == ["t1", "t4"]
    seeds = corpus.filter("track_id = 't1'").withColumn("request_id", F.lit(1))
    rows = retrieval.similar(corpus, seeds, ["top", "left"], 9).orderBy("rank").collect()
    assert rows[0]["track_id"] == "t1" and rows[0]["score"] == 1 and len(rows) == 5


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, note string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "y")], "id int, name string, note string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merge.insert_if_absent(old, new, ["id"])) == [(1, "a", None), (2, "b", "x"), (3, "d", "y")]
    assert rows(merge.upsert(old, new, ["id"], overwrite=["name"], if_given=["note"])) == [(1, "a", None), (2, "c", "x"), (3, "d", "y")]
    members = spark.createDataFrame([("p1", "t_old", None), ("p2", "t", None)], "playlist_id string, track_id string, removed_at string")
    now = merge.sync_members(members, spark.createDataFrame([("p1", "t_new")], "playlist_id string, track_id string"), members.filter("playlist_id = 'p1'"), "now")
    assert rows(now.fillna("-")) == [("p1", "t_new", "-"), ("p1", "t_old", "now"), ("p2", "t", "-")]


def test_modes_and_temporal(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "g string, v string")
    assert [tuple(r) for r in profile.mode_of(df, "g", "v").collect()] == [("a", "x")]
    t = spark.createDataFrame([(1959, 320000), (2024, None), (None, 260000)], "year int, duration_ms long")
    rows = features.temporal(t, 2026).orderBy("duration_ms").collect()
    assert [r["year_normalized"] for r in rows] == [1.0, 0.5, 0.0] and rows[0]["duration_ms_normalized"] == 0.5 and rows[0]["years_since_release"] == 2.0
