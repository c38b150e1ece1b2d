"""Joins and aggregates that build track, artist and playlist profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.domain import AUDIO
from . import quantiles


def track_genre(tracks: DataFrame, genre_map: DataFrame, genre_xy: DataFrame) -> DataFrame:
    """Genre labels and coordinates with their source: manual (mapped), lookup (coordinates only), unknown."""
    m = genre_map.select("first_genre", "gen_4", "gen_6", "gen_8", F.col("top").alias("mt"), F.col("left").alias("ml"), F.lit(True).alias("mapped"))
    x = genre_xy.select("first_genre", F.col("top").alias("xt"), F.col("left").alias("xl"), F.lit(True).alias("placed"))
    joined = tracks.select("track_id", "first_genre").join(F.broadcast(m), "first_genre", "left").join(F.broadcast(x), "first_genre", "left")
    source = F.when(F.col("mapped"), "manual").when(F.col("placed"), "lookup").otherwise("unknown")
    return joined.select("track_id", "first_genre", "gen_4", "gen_6", "gen_8", F.coalesce("mt", "xt").alias("top"), F.coalesce("ml", "xl").alias("left"), source.alias("genre_source"))


def track_profile(tracks: DataFrame, audio: DataFrame, genre: DataFrame, faves: DataFrame) -> DataFrame:
    out = tracks.join(audio, "track_id", "left").join(genre.drop("first_genre"), "track_id", "left")
    return out.join(faves.withColumnRenamed("score", "fave_score"), "track_id", "left").withColumn("fave_score", F.coalesce("fave_score", F.lit(0.0)))


def mode_of(df: DataFrame, by: str, value: str) -> DataFrame:
    """The commonest non-null value of each group; ties go to the least value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n"))
    first = Window.partitionBy(by).orderBy(F.desc("__n"), value)
    return counts.withColumn("__k", F.row_number().over(first)).filter("__k = 1").select(by, value)


def top_values(df: DataFrame, by: str, value: str, n: int, out: str) -> DataFrame:
    """The n commonest values of each group, comma-joined, commonest first, ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("m"), F.col(value).alias("v"))))
    return counts.groupBy(by).agg(F.array_join(F.transform(F.slice(ranked, 1, n), lambda x: x["v"]), ",").alias(out))


def medians(df: DataFrame, by: list[str], columns: list[str] = AUDIO) -> DataFrame:
    return quantiles.medians(df, columns, by)


def genre_lists(rows: DataFrame, by: str, value: str, n: int = 5) -> DataFrame:
    """(by, top_genres, other_genres): the n commonest values of each group and the others, as JSON arrays, commonest first, ties by
    value. A group's different values are listed, not its rows."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n"))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("m"), F.col(value).alias("v")))), lambda x: x["v"])
    listed = counts.groupBy(by).agg(ranked.alias("__all"))
    return listed.select(by, F.to_json(F.slice("__all", 1, n)).alias("top_genres"), F.to_json(F.slice("__all", n + 1, 1_000_000)).alias("other_genres"))


def group_profile(members: DataFrame, genre: DataFrame, by: str) -> DataFrame:
    """Mean coordinates, size, modal labels and top-5 genres of each artist or playlist."""
    rows = members.join(genre, "track_id")
    out = rows.groupBy(by).agg(F.round(F.avg("top"), 6).alias("top"), F.round(F.avg("left"), 6).alias("left"), F.count("*").alias("track_count"))
    for level in ("gen_4", "gen_6", "gen_8"):
        out = out.join(mode_of(rows, by, level), by, "left")
    return out.join(top_values(rows, by, "first_genre", 5, "top_genres"), by, "left")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def null_report(df: DataFrame) -> DataFrame:
    """Nulls and their share by column, in one pass."""
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.unpivot("rows", df.columns, "column", "nulls").select("column", "nulls", F.round(F.col("nulls") * 100 / F.col("rows"), 4).alias("pct"))


def five_numbers(df: DataFrame, by: str, value: str) -> DataFrame:
    q = quantiles.quantiles(df, [value], [0.0, 0.25, 0.5, 0.75, 1.0], [by])
    return q.select(by, F.col("q")[0].alias("low"), F.slice("q", 2, 3).alias("q"), F.col("q")[4].alias("high")).select(by, F.round("low", 6).alias("low"), *(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)), F.round("high", 6).alias("high"))


def outlier_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Quartiles, fences and the rows beyond them, by column."""
    long = df.unpivot([], columns, "feature", "value").filter("value is not null")
    q = quantiles.quantiles(df, columns, [0.25, 0.75]).select("feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    out = (F.col("value") < F.col("q1") - k * (F.col("q3") - F.col("q1"))) | (F.col("value") > F.col("q3") + k * (F.col("q3") - F.col("q1")))
    return long.join(F.broadcast(q), "feature").groupBy("feature").agg(F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("q3"), 6).alias("q3"), F.count_if(out).alias("outliers"), F.round(F.count_if(out) * 100 / F.count("*"), 4).alias("pct"))


#: Holders of an item that meet each other in one place.
HOLDERS = 1000


def shared_items(sets: DataFrame, by: str, item: str, holders: int = HOLDERS) -> DataFrame:
    """(a, b, shared): how many items every two groups have in common, a before b. sets: different (by, item). The holders of an item
    are dealt to blocks of about `holders`, and every two blocks meet in a place of their own, so that an item that all groups have is
    no task of its own. Only pairs of groups that share something come out."""
    pairs = sets.select(F.col(by).alias("a"), F.col(item).alias("item"))
    blocks = pairs.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").select("item", F.ceil(F.col("n") / holders).cast("int").alias("n"))
    dealt = pairs.join(blocks, "item").select("item", "a", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("i"), F.sequence(F.lit(0), F.col("n") - 1).alias("all"))
    x = dealt.select("item", "a", "i", F.explode("all").alias("j"))
    y = dealt.select("item", F.col("a").alias("b"), F.col("i").alias("j"), F.explode("all").alias("i"))
    return x.join(y, ["item", "i", "j"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def jaccard_matrix(sets: DataFrame, by: str, item: str, holders: int = HOLDERS) -> DataFrame:
    """Jaccard similarity of every two groups that share an item, themselves included. Sets are made distinct first."""
    pairs = sets.select(by, item).filter(F.col(item).isNotNull()).distinct()
    sizes = pairs.groupBy(by).agg(F.count("*").alias("n"))
    one = shared_items(pairs, by, item, holders)
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).unionByName(sizes.select(F.col(by).alias("a"), F.col(by).alias("b"), F.col("n").alias("shared")))
    out = both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return out.select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))
