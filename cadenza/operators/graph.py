"""Clusters of a graph of neighbours, by power iteration."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def neighbour_edges(near: DataFrame) -> DataFrame:
    """(a, b, w): both directions of each pair of near (request_id, track_id, score > 0), once, with the larger score; no row with itself."""
    pairs = near.filter("request_id <> track_id and score > 0").select(F.col("request_id").alias("a"), F.col("track_id").alias("b"), F.col("score").alias("w"))
    return pairs.union(pairs.select("b", "a", "w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def power_iteration(edges: DataFrame, rounds: int = 30, eps: float = 1e-5, every: int = 3) -> DataFrame:
    """(id, v): the product of the row-normalised weights with a vector that begins as each node's share of all weight, again and again,
    scaled to a sum of 1. It stops before it has settled: when the change of a round differs from that of the round before by no more
    than eps / n at any node, or after `rounds`. By then nodes that hang together have come together, and those of other clusters are
    still apart. edges: (a, b, w), both directions. A round is one join and one sum; each `every`-th ends in a checkpoint."""
    degree = edges.groupBy("a").agg(F.sum("w").alias("d"))
    steps = cut(edges.join(degree, "a").select("a", "b", (F.col("w") / F.col("d")).alias("p")))
    total = degree.agg(F.sum("d").alias("s"), F.count("*").alias("n")).first()
    if not total["n"]:
        return degree.select(F.col("a").alias("id"), F.col("d").alias("v"))
    state = cut(degree.select(F.col("a").alias("id"), (F.col("d") / total["s"]).alias("v"), F.lit(0.0).alias("change")))
    for i in range(1, rounds + 1):
        product = steps.join(state.select(F.col("id").alias("b"), "v"), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("p") * F.col("v")).alias("next"))
        both = product.join(state, "id").select("id", F.col("next").alias("v"), F.abs(F.col("next") - F.col("v")).alias("change"), F.col("change").alias("before"))
        if i % every:
            state = both.drop("before")
            continue
        both = cut(both)
        ends = both.agg(F.sum("v").alias("s"), F.max(F.abs(F.col("change") - F.col("before"))).alias("e")).first()
        state = both.select("id", (F.col("v") / ends["s"]).alias("v"), "change")
        if ends["e"] <= eps / total["n"]:
            break
    return state.select("id", "v")


def graph_clusters(edges: DataFrame, k: int = 6, rounds: int = 30, seed: int = 42) -> DataFrame:
    """(id, v, cluster_id): k-means on the vector of power_iteration. Nodes without edges have no row."""
    placed = cut(power_iteration(edges, rounds))
    # in units of its spread, as the values are all near 1 / n
    ends = placed.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("one", F.lit(1))
    unit = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    rows = placed.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one").select("id", "v", array_to_vector(F.array(unit)).alias("features"))
    if placed.isEmpty():
        return placed.withColumn("cluster_id", F.lit(0))
    return KMeans(k=k, seed=seed, predictionCol="cluster_id").fit(rows).transform(rows).select("id", "v", "cluster_id")
