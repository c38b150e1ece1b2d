"""Audits of rankings and playlists, samples with labels, recommendations for playlists, choice of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import key_distance, min_max
from .profile import mode_of
from .recommend import centroids
from .retrieval import similar
from .scoring import LOWER_IS_BETTER


def hash_order(key: Column, seed: int = 42) -> Column:
    """A fixed shuffled order of keys, the same in every run."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first in the order of a hash of the key; each task keeps n rows before anything moves."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def labelled(corpus: DataFrame, positives: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """Adds label: all rows with a key among the positives (1) and at most `most` others (0), by hash order."""
    mark = positives.select(key).distinct().withColumn("label", F.lit(1))
    rows = corpus.join(mark, key, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return rows.filter("label = 1").unionByName(hash_sample(rows.filter("label = 0"), key, most))


def ranked_by_value(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Adds rank: 1 and how many rows of the group have a greater value. Ranks come from counts of distinct values, so that no
    task holds a group."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("__n"))
    above = F.sum("__n").over(Window.partitionBy(by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(n.select(by, value, (1 + F.coalesce(above, F.lit(0))).alias("rank")), [by, value])


def known_ranks(ranked: DataFrame, known: DataFrame, by: str, key: str, cuts: tuple[int, ...] = (50, 100, 500)) -> DataFrame:
    """Where known good rows stand in each group's ranking: how many, mean, median, best, worst rank, and how many within each cut."""
    hits = ranked.join(known.select(key).distinct(), key, "left_semi")
    return hits.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean"), F.percentile("rank", 0.5).alias("median"), F.min("rank").alias("best"), F.max("rank").alias("worst"),
        *(F.count_if(F.col("rank") <= c).alias(f"top_{c}") for c in cuts),
    )


def first_of(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their place, from 1. Tasks keep k rows a group before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def side_by_side(a: DataFrame, b: DataFrame, by: str, key: str) -> DataFrame:
    """Two rankings (by, place, key) next to each other; the shorter one gives nulls."""
    return a.select(by, "place", F.col(key).alias("a")).join(b.select(by, "place", F.col(key).alias("b")), [by, "place"], "full")


def failures(top: DataFrame, members: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Per group of a top list: rows that are no members, their mean value, and how far it is from the members' mean there."""
    mark = members.select(key).distinct().withColumn("__in", F.lit(True))
    rows = top.join(mark, key, "left")
    out, in_ = F.when(F.col("__in").isNull(), F.col(value)), F.when(F.col("__in"), F.col(value))
    return rows.groupBy(by).agg(F.count_if(F.col("__in").isNull()).alias("n"), F.round(F.avg(out), 6).alias("mean"), F.round(F.avg(out) - F.avg(in_), 6).alias("gap"))


def harmonic_profile(rows: DataFrame, by: str, label: str) -> DataFrame:
    """Modal key of each group, mean distance of its rows' keys from it, and rows at each distance from 0 to 6."""
    counts = rows.groupBy(by, label).agg(F.count("*").alias("n"))
    d = counts.join(mode_of(rows, by, label).select(by, F.col(label).alias("modal")), by).withColumn("d", key_distance(F.col(label), F.col("modal")))
    return d.groupBy(by, "modal").agg(F.round(F.sum(F.col("n") * F.col("d")) / F.sum("n"), 6).alias("mean_distance"), *(F.coalesce(F.sum(F.when(F.col("d") == i, F.col("n"))), F.lit(0)).alias(f"at_{i}") for i in range(7)))


def scaled_centroids(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Each group's means, scaled to 0..1 over the groups."""
    means = rows.groupBy(by).agg(*(F.avg(c).alias(c) for c in columns))
    ends = means.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).withColumn("__one", F.lit(1))
    both = means.withColumn("__one", F.lit(1)).join(F.broadcast(ends), "__one")
    return both.select(by, *(F.round(min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")), 6).alias(c) for c in columns))


def for_playlists(corpus: DataFrame, members: DataFrame, features: list[str], k: int) -> DataFrame:
    """The k tracks most similar to each playlist's mean track that aren't in it. members: (request_id, track_id); they are left out
    where they meet the playlist, before the list of k."""
    return similar(corpus, centroids(corpus, members, features), features, k, without=members).select("request_id", "track_id", "score", F.col("rank").alias("place"))


def best_model(table: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """Per metric: the model with the best mean over the groups (ties by name) and that mean."""
    long = table.unpivot([model], columns, "metric", "value").groupBy("metric", model).agg(F.round(F.avg("value"), 5).alias("mean"))
    sign = F.when(F.col("metric").isin(LOWER_IS_BETTER), 1).otherwise(-1)
    ranked = first_of(long.filter("mean is not null"), "metric", [sign * F.col("mean"), F.col(model)], 1)
    return ranked.select("metric", F.col(model).alias("model"), "mean")


def disagreements(table: DataFrame, by: str, model: str, a: str, b: str, metric: str, n: int = 5) -> DataFrame:
    """The n groups on which two models differ most."""
    side = lambda m, name: table.filter(F.col(model) == m).select(by, F.col(metric).alias(name))
    both = side(a, "va").join(side(b, "vb"), by).withColumn("delta", F.round(F.col("va") - F.col("vb"), 6))
    return both.orderBy(F.desc(F.abs("delta")), by).limit(n)
