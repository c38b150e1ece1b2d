"""Soft clusters of feature vectors: fits, memberships, filters and indices of quality."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scaled_vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Adds a vector of the columns scaled to 0..1 (missing and constant ones 0)."""
    bounds = df.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns)).withColumn("__one", F.lit(1))
    part = lambda c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumn("__one", F.lit(1)).join(F.broadcast(bounds), "__one")
    return rows.select(*df.columns, array_to_vector(F.array(*map(part, columns))).alias(out))


def soft_clusters(rows: DataFrame, k: int = 8, seed: int = 42, starts: int = 2, rounds: int = 20) -> DataFrame:
    """Fits a Gaussian mixture on `features`, the likeliest of several starts (one can end in a poor optimum); adds probs (they sum to 1),
    cluster_id and cluster_prob. The rows are written once, in as few parts as tasks run at once, since every round reads them."""
    from .storage import cut

    rows = cut(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism))
    fits = [GaussianMixture(k=k, seed=seed + i, maxIter=rounds).fit(rows) for i in range(starts)]
    model = max(fits, key=lambda m: m.summary.logLikelihood)
    return most_likely(model.transform(rows).withColumn("probs", vector_to_array("probability")).drop("probability", "prediction"))


def most_likely(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cluster_id", (F.array_position("probs", F.array_max("probs")) - 1).cast("int")).withColumn("cluster_prob", F.array_max("probs"))


def label_centroids(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector of each label, as an array."""
    cells = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def inverse_distance_probs(vectors: DataFrame, centroids: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """Given memberships without a fitted model: inverse distances to the centroids, scaled to sum to 1, in order of label. There is one
    centroid for each label, so the side that goes to every task is as small as the list of labels."""
    near = F.broadcast(centroids.select(F.col(label).alias("__label"), "centre"))
    weight = 1 / (F.sqrt(squared_distance(F.col(vector), F.col("centre"))) + 1e-9)
    rows = vectors.join(near).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__label", weight.alias("w")))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["w"])
    return most_likely(rows.select(key, F.transform("w", lambda x: x["w"] / total).alias("probs")))


def same_cluster(corpus: DataFrame, requests: DataFrame, least: float = 0.05) -> DataFrame:
    """Pairs of (request_id, corpus row) whose most likely cluster has at least that probability for the request; a request for which
    no row is left gets the full corpus. corpus: track_id, cluster_id; requests: request_id, probs."""
    wanted = requests.select("request_id", F.posexplode("probs").alias("cluster_id", "p")).filter(F.col("p") >= least).drop("p")
    filled = corpus.select("cluster_id").distinct()
    lone = requests.select("request_id").join(wanted.join(filled, "cluster_id", "left_semi"), "request_id", "left_anti")
    every = filled.agg(F.collect_set("cluster_id").alias("all")).withColumn("__one", F.lit(1))  # the clusters' numbers
    all_of = lone.withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one").select("request_id", F.explode("all").alias("cluster_id"))
    return corpus.join(wanted.unionByName(all_of), "cluster_id")


def cluster_profile(rows: DataFrame) -> DataFrame:
    """Sizes and confidence of each most likely cluster."""
    p = F.col("cluster_prob")
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"), r(F.avg(p), "mean"), r(F.median(p), "median"), r(F.min(p), "low"), r(F.max(p), "high"), r(F.avg((p < 0.5).cast("double")), "unsure"))


def variance_ratio(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski and Harabasz's index on given labels, with the sums of squares within and between."""
    cells = vectors.select(label, F.posexplode(vector).alias("i", "x"))
    moments = cells.groupBy(label, "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = moments.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c"))
    sums = total.agg(F.sum(F.col("q") - F.col("c")).alias("within"), F.sum(F.col("c") - F.col("s") * F.col("s") / F.col("n")).alias("between"), F.max("n").alias("n")).withColumn("one", F.lit(1))
    groups = moments.agg(F.countDistinct(label).alias("k")).withColumn("one", F.lit(1))
    both = sums.join(F.broadcast(groups), "one")
    ratio = (F.col("between") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))
    return both.select(F.round("within", 4).alias("within"), F.round("between", 4).alias("between"), F.round(ratio, 4).alias("ratio"))


def davies_bouldin(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """Davies and Bouldin's index on given labels: the mean over labels of the largest (spread + other's spread) / distance of the centres;
    a spread is the mean distance of a label's rows from its centre. Labels with the same centre are left out of each other's largest."""
    centres = label_centroids(vectors, vector, label)
    rows = vectors.join(F.broadcast(centres), label)  # a row a label
    spread = rows.groupBy(label).agg(F.avg(F.sqrt(squared_distance(F.col(vector), F.col("centre")))).alias("s"), F.first("centre").alias("c"))
    a, b = spread.toDF("a", "sa", "ca"), spread.toDF("b", "sb", "cb")
    apart = F.sqrt(squared_distance(F.col("ca"), F.col("cb")))
    pairs = a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", ((F.col("sa") + F.col("sb")) / F.nullif(apart, F.lit(0.0))).alias("r"))
    return pairs.groupBy("a").agg(F.max("r").alias("r")).agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def silhouettes(vectors: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """(key, label, silhouette) by squared distances: the mean ones to the own and to the nearest other label follow from the labels' means
    and mean squares, so work is in proportion to rows times labels. A label of one row gives 0."""
    cells = vectors.select(label, F.posexplode(vector).alias("i", "x"))
    moments = cells.groupBy(label, "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"))
    groups = moments.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"), F.sum("q").alias("q"))
    all_groups = groups.agg(F.collect_list(F.struct(F.col(label).alias("label"), "n", "m", "q")).alias("groups")).withColumn("__one", F.lit(1))  # a row a label
    rows = vectors.withColumn("__one", F.lit(1)).join(F.broadcast(all_groups), "__one")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)
    rows = rows.withColumn("__d", F.transform("groups", lambda g: F.struct(g["label"].alias("label"), g["n"].alias("n"), (dot(F.col(vector), F.col(vector)) - 2 * dot(F.col(vector), g["m"]) + g["q"]).alias("d"))))
    own = F.filter("__d", lambda g: (g["label"] == F.col(label)) & (g["n"] > 1))
    a = F.get(F.transform(own, lambda g: g["d"] * g["n"] / (g["n"] - 1)), 0)
    b = F.array_min(F.transform(F.filter("__d", lambda g: g["label"] != F.col(label)), lambda g: g["d"]))
    return rows.select(key, label, F.coalesce((b - a) / F.greatest(a, b), F.lit(0.0)).alias("silhouette"))


def dense_groups(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(id, cluster_id) of points (id, top, left): groups of core points (with `least` points within the radius, themselves included) that
    reach each other, named by their least id; other points join the group of a core point in reach, the one with the least name, or are
    noise, -1. Neighbours come from a grid join; labels spread by rounds, each of which ends in a checkpoint."""
    from .retrieval import within_radius
    from .storage import cut

    spots = points.select(F.col("id").alias("track_id"), "top", "left")
    centres = points.select(F.col("id").alias("name"), F.col("top").alias("top0"), F.col("left").alias("left0"))
    near = cut(within_radius(spots, centres, radius).select(F.col("name").alias("a"), F.col("track_id").alias("b")))
    core = near.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("a")
    links = cut(near.join(core, "a", "left_semi").join(core.toDF("b"), "b", "left_semi").select("a", "b"))
    labels = cut(core.select("a", F.col("a").alias("c")))
    while True:
        spread = links.join(labels.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        spread = cut(spread.join(labels.toDF("c", "d"), "c", "left").select("a", F.least("c", F.coalesce("d", "c")).alias("c")))
        moved = spread.join(labels.toDF("a", "was"), "a").filter("c <> was").isEmpty()
        labels = spread
        if moved:
            break
    joined = near.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("cluster_id"))
    return points.select("id").join(joined, "id", "left").select("id", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"))


def sweep(spark: SparkSession, rows: DataFrame, ks: list[int], seed: int = 42, kinds: tuple[str, ...] = ("kmeans", "bisecting")) -> DataFrame:
    """Cost and silhouette of k-means and of bisecting k-means for each k. One small row a fit goes through the driver."""
    judge, found, rows = ClusteringEvaluator(), [], rows.persist()
    for k in ks:
        for name, kind in ((n, c) for n, c in (("kmeans", KMeans), ("bisecting", BisectingKMeans)) if n in kinds):
            model = kind(k=k, seed=seed).fit(rows)
            found.append((name, k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(rows)))))
    rows.unpersist()
    return spark.createDataFrame(found, "algorithm string, k int, cost double, silhouette double")


def best_k(swept: DataFrame) -> DataFrame:
    """(algorithm, k, silhouette): the k of the largest silhouette of each algorithm, the least of equals."""
    best = swept.groupBy("algorithm").agg(F.min(F.struct((-F.col("silhouette")).alias("m"), "k")).alias("best"))
    return best.select("algorithm", "best.k", (-F.col("best.m")).alias("silhouette"))


def hierarchical(rows: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """rows (features: vector and others) with cluster_id, by divisive clustering: the largest cluster is halved until there are k."""
    model = BisectingKMeans(k=k, seed=seed, predictionCol="cluster_id").fit(rows)
    return model.transform(rows)


def explained_variance(spark: SparkSession, rows: DataFrame, k: int) -> DataFrame:
    shares = PCA(k=k, inputCol="features", outputCol="p").fit(rows).explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i, s, sum(shares[: i + 1])) for i, s in enumerate(shares)], "component int, share double, cumulative double")
