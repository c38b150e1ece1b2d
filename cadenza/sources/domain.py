"""The music-library tables, derived from the star-schema tables at hand, and the same definitions as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import cut

# Names of the imputable audio features and of pitch classes.
AUDIO = ["danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo"]
KEYS = ["C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]

_EXPRESSIONS = {
    "danceability": "avg(l_quantity) / 50", "energy": "avg(l_discount) * 10", "loudness": "-60 + avg(l_tax) * 500", "speechiness": "avg(l_linenumber) / 7",
    "acousticness": "avg(l_extendedprice) / 100000", "instrumentalness": "max(l_discount) * 5", "liveness": "min(l_quantity) / 50", "valence": "max(l_tax) * 10", "tempo": "60 + avg(l_quantity) * 4",
}


def _released() -> Column:
    return F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("release_date")


def _audio() -> list[Column]:
    from ..functions.scalars import rounded

    return [rounded(F.expr(e), 6).alias(c) for c, e in _EXPRESSIONS.items()]


@dataclass
class Library:
    """Lazy domain tables over a folder of Parquet tables."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def keep(self, *names: str) -> None:
        """Writes derived tables once, for a query that reads them several times. Tracks and audio features come from one pass over their rows,
        if both are asked for."""
        if {"tracks", "audio_features"} <= set(names) and not {"tracks", "audio_features"} & self._kept:
            self.__dict__["_items"] = cut(self.table("lineitem").groupBy(F.col("l_partkey").alias("track_id")).agg(_released(), *_audio()))
            for name in ("tracks", "audio_features"):
                self.__dict__.pop(name, None)
            self._kept.add("audio_features")  # its rows are written already
        for name in names:
            if name not in self._kept:
                self.__dict__[name] = cut(getattr(self, name))
                self._kept.add(name)

    @cached_property
    def _kept(self) -> set[str]:
        return set()

    @cached_property
    def _items(self) -> DataFrame | None:
        """(track_id, release_date and AUDIO), where keep() has written them."""
        return None

    @cached_property
    def tracks(self) -> DataFrame:
        first = self.table("lineitem").groupBy("l_partkey").agg(_released()) if self._items is None else self._items.select(F.col("track_id").alias("l_partkey"), "release_date")
        part = self.table("part").join(first, F.col("p_partkey") == F.col("l_partkey"), "left")
        genre = F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand"))
        return part.select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("track_name"), genre.alias("first_genre"), F.col("p_type").alias("genre_cat"), F.col("p_size").cast("double").alias("popularity"), "release_date")

    @cached_property
    def audio_features(self) -> DataFrame:
        if self._items is None:
            made = self.table("lineitem").filter("l_partkey % 7 <> 0").groupBy(F.col("l_partkey").alias("track_id")).agg(*_audio())
        else:
            made = self._items.filter("track_id % 7 <> 0").select("track_id", *AUDIO)
        for i, c in enumerate(AUDIO):  # single gaps
            made = made.withColumn(c, F.when((F.col("track_id") % 13 != 0) | (F.col("track_id") % 9 != i), F.col(c)))
        key = F.when(F.col("track_id") % 29 == 0, -1).otherwise(F.col("track_id") % 12).cast("int")
        return made.select("*", F.lit("spotify").alias("features_source"), key.alias("key"), (F.col("track_id") % 2).cast("int").alias("mode"), (180000 + F.col("track_id") % 1000 * 100).cast("long").alias("duration_ms"))

    @cached_property
    def genre_xy(self) -> DataFrame:
        n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        brands = self.table("part").select("p_brand", n.alias("n")).distinct().filter("n <= 22")
        return brands.select(F.col("p_brand").alias("first_genre"), (F.col("n") * 211 % 5000).cast("double").alias("top"), (F.col("n") * 397 % 3000).cast("double").alias("left"), "n")

    @cached_property
    def genre_map(self) -> DataFrame:
        label = lambda k: F.concat(F.lit(f"g{k}_"), (F.col("n") % k).cast("string")).alias(f"gen_{k}")
        return self.genre_xy.filter("n <= 18").select("first_genre", label(4), label(6), label(8), "top", "left")

    @cached_property
    def playlist_tracks(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id")).distinct()

    @cached_property
    def members(self) -> DataFrame:
        """Large playlists: one for each nation and market segment."""
        who = self.table("customer").select("c_custkey", F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("playlist_id"))
        orders = self.table("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "playlist_id")
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("playlist_id", F.col("l_partkey").alias("track_id")).distinct()

    @cached_property
    def track_artists(self) -> DataFrame:
        return self.table("lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("artist_id")).distinct()

    @cached_property
    def artists(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist_name"), F.col("s_acctbal").alias("popularity"))

    @cached_property
    def faves(self) -> DataFrame:
        return self.table("part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("track_id"), (F.col("p_size") / 10).alias("score"))

    @cached_property
    def plays(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("item"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")


SQL = (
    """
tracks as (
  select p_partkey as track_id, p_name as track_name, case when p_partkey % 11 <> 0 then p_brand end as first_genre, p_type as genre_cat, cast(p_size as double) as popularity, release_date
  from part left join (select l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') as release_date from lineitem group by 1) on p_partkey = l_partkey
), audio_raw as (
  select l_partkey as track_id, """
    + ", ".join(f"round({e}, 6) as {c}" for c, e in _EXPRESSIONS.items())
    + """ from lineitem where l_partkey % 7 <> 0 group by 1
), audio_features as (
  select track_id, """
    + ", ".join(f"case when track_id % 13 <> 0 or track_id % 9 <> {i} then {c} end as {c}" for i, c in enumerate(AUDIO))
    + """, 'spotify' as features_source, cast(case when track_id % 29 = 0 then -1 else track_id % 12 end as integer) as key, cast(track_id % 2 as integer) as mode,
    180000 + track_id % 1000 * 100 as duration_ms from audio_raw
), genre_xy as (
  select p_brand as first_genre, cast(n * 211 % 5000 as double) as top, cast(n * 397 % 3000 as double) as "left", n
  from (select distinct p_brand, cast(regexp_extract(p_brand, '(\\d+)', 1) as integer) as n from part) where n <= 22
), genre_map as (
  select first_genre, 'g4_' || n % 4 as gen_4, 'g6_' || n % 6 as gen_6, 'g8_' || n % 8 as gen_8, top, "left" from genre_xy where n <= 18
), playlist_tracks as (
  select distinct l_orderkey as playlist_id, l_partkey as track_id from lineitem
), members as (
  select distinct c_nationkey || '-' || c_mktsegment as playlist_id, l_partkey as track_id
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
), track_artists as (
  select distinct l_partkey as track_id, l_suppkey as artist_id from lineitem where l_linenumber = 1
), artists as (
  select s_suppkey as artist_id, s_name as artist_name, s_acctbal as popularity from supplier
), faves as (
  select p_partkey as track_id, p_size / 10 as score from part where p_partkey % 5 = 0
), plays as (
  select event_id, user_id, ts, event_type, cast(json_extract_string(props, '$.k') as integer) as item from events
), turns as (
  select * from conversations
), track_genre as (
  select t.track_id, t.first_genre, m.gen_4, m.gen_6, m.gen_8, coalesce(m.top, x.top) as top, coalesce(m."left", x."left") as "left",
    case when m.first_genre is not null then 'manual' when x.first_genre is not null then 'lookup' else 'unknown' end as genre_source
  from tracks t left join genre_map m using (first_genre) left join genre_xy x using (first_genre)
)"""
)
