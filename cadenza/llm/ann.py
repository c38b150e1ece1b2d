"""Approximate nearest neighbours by largest inner product: inverted lists, scanned by an adaptive number of dimensions.

Vectors get one more coordinate that makes their lengths equal, so that the largest inner product is the least distance. All
are rotated at random; then any first dimensions are a fair sample of a distance. A list is scanned column block by column
block: after each, a hypothesis test abandons the candidates whose partial distance is already too large to be among the
nearest. What is left is scored exactly, in double precision, on the original vectors. A query's nearest list is scanned
first; the distance of its k-th best there is the limit that goes along to its other lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Centroids and the number of lists to probe are fitted on SAMPLE vectors at most, picked by hash. Column blocks have STEP
#: dimensions; EPSILON is the significance of the test. BLOCK bounds the candidates, QUERIES the queries of one task's group.
SAMPLE, TRIALS, RECALL, STEP, EPSILON, BLOCK, QUERIES = 16_384, 256, 0.97, 16, 2.1, 4096, 1024
#: Share of the pairs still alive above which a column block is worked out for all of them.
DENSE = 0.05


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(1)))[:, None]])


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids by distance from each row of x, nearest first."""
    return np.argsort((centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T, axis=1, kind="stable")


def fit_lists(sample: np.ndarray, n_lists: int, longest: float, k: int) -> tuple[np.ndarray, int]:
    """k-means centroids, and how many lists a query must probe for the recall asked for, tried out on the sample."""
    rng = np.random.default_rng(11)
    x = lift(sample, longest)
    centroids = x[rng.choice(len(x), min(n_lists, len(x)), replace=False)]
    for _ in range(8):
        own = nearest_centroids(x, centroids)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=len(centroids))
        centroids = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], centroids)
    own = nearest_centroids(x, centroids)[:, 0]
    tried = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    scores = sample[tried] @ sample.T
    scores[np.arange(len(tried)), tried] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    if not best.size:
        return centroids, 1
    queries = np.hstack([sample[tried], np.zeros((len(tried), 1))])
    rank = np.argsort(nearest_centroids(queries, centroids), axis=1)
    reached = np.sort(np.take_along_axis(rank, own[best], 1).ravel())
    return centroids, int(reached[min(len(reached) - 1, int(np.ceil(RECALL * len(reached))))]) + 1


def scan(queries: np.ndarray, limits: np.ndarray, candidates: np.ndarray, ids: np.ndarray, own: np.ndarray, turn: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score), the k best candidates found for each query and nearer than its limit (a squared distance, or
    infinity); ties to the smaller id. Queries and candidates are compared as pairs, of which each column block leaves fewer."""
    d = len(turn)
    rotated = lift(candidates, longest) @ turn
    asked = np.hstack([queries, np.zeros((len(queries), 1))]) @ turn
    near = lambda part, limit, seen: part <= limit * (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / d + 1e-9
    part, alive, i = np.zeros((len(asked), len(rotated))), own[:, None] != ids[None, :], 0
    while i < d and alive.mean() > DENSE:  # many are left: the next columns of all pairs at once
        x, y = asked[:, i : i + STEP], rotated[:, i : i + STEP]
        part += (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        i = min(i + STEP, d)
        alive &= near(part, limits[:, None], i)
    q, c = np.nonzero(alive)
    part = part[q, c]
    while i < d:
        block = slice(i, min(i + STEP, d))
        part = part + ((rotated[c, block] - asked[q, block]) ** 2).sum(1)
        i = block.stop
        keep = near(part, limits[q], i)
        q, c, part = q[keep], c[keep], part[keep]
    if len(q) > 4 * k * len(asked):  # no limit to go by: only the nearest of each query are scored
        order = np.lexsort((part, q))
        q, c = q[order], c[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < 4 * k
        edge = part[order] <= part[order][np.minimum(np.searchsorted(q, q) + k - 1, len(q) - 1)] * (1 + 1e-9) + 1e-9
        q, c = q[first | edge], c[first | edge]
    score = np.empty(len(q))
    for i in range(0, len(q), 65_536):
        score[i : i + 65_536] = (queries[q[i : i + 65_536]] * candidates[c[i : i + 65_536]]).sum(1)
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[c][rank < k], score[rank < k]


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest other rows that were found.

    Nearest is the largest inner product of the original vectors, in double precision; ties go to the smaller id. Vectors that
    are null or zero, hold null or non-finite components, or are not of the commonest length (ties: the shorter) take no part;
    neither do null ids. Rows with the query's own id are not its neighbours. An empty table gives no rows. Every vector is
    indexed. Lists are dealt out in blocks of bounded size, met by bounded groups of queries, so that neither a list that
    holds most vectors nor one that most queries probe is a task of its own.
    """
    spark = df.sparkSession
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == sizes["d"])
    longest, n = float(sizes["longest"]) * (1 + 1e-12), sizes["n"]
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).select("v").collect()])
    centroids, probes = fit_lists(sample, int(min(SAMPLE / 4, max(1, np.sqrt(n) / 2))), longest, k)
    index = spark.sparkContext.broadcast((centroids, rotation(sizes["d"] + 1)))

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        return pd.Series(nearest_centroids(lift(np.stack(vectors.to_numpy()), longest), index.value[0])[:, 0].astype(np.int32))

    listed = cut(rows.withColumn("list", home("v")))
    held = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # as many as centroids
    sizes = np.array([held.get(i, 0) for i in range(len(centroids))])

    @F.pandas_udf("array<int>")
    def probed(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy())
        order = nearest_centroids(np.hstack([x, np.zeros((len(x), 1))]), index.value[0])
        enough = 1 + (np.cumsum(sizes[order], 1) <= k).sum(1)  # lists that hold k vectors besides the query
        return pd.Series([o[: max(probes, m)].astype(np.int32) for o, m in zip(order, enough, strict=True)])

    queries = cut(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v", probed("v").alias("lists")))

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, own, q = candidates["vec_id"].to_numpy(), asked["query_id"].to_numpy(), np.stack(asked["q"].to_numpy())
        worst = asked["worst"].to_numpy(np.float64)  # a score, from which the squared distance follows
        limits = np.where(np.isnan(worst), np.inf, (longest + (q * q).sum(1) - 2 * worst) * (1 + 1e-9) + 1e-9)
        at, found, score = scan(q, limits, np.stack(candidates["v"].to_numpy()), ids, own, index.value[1], longest, k)
        return pd.DataFrame({"query_id": own[at], "vec_id": found, "score": score})

    def searched(asked: DataFrame) -> DataFrame:
        """asked: (query_id, q, list, worst). Each list's blocks of vectors meet its groups of queries."""
        asking = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
        parts = spark.createDataFrame([(i, -(-held[i] // BLOCK), -(-asking[i] // QUERIES)) for i in held if i in asking], "list int, blocks int, groups int")
        a = listed.join(F.broadcast(parts), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        a = a.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("list", "block", "group", "vec_id", "v")
        b = asked.join(F.broadcast(parts), "list").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
        b = b.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "group", "query_id", "q", "worst")
        keys = ["list", "block", "group"]
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    at_home = queries.select("query_id", F.col("v").alias("q"), F.col("lists")[0].alias("list"), F.lit(None).cast("double").alias("worst"))
    first = cut(best(searched(at_home)))
    limit = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    rest = queries.select("query_id", F.col("v").alias("q"), F.explode(F.slice("lists", 2, len(centroids))).alias("list")).join(limit, "query_id", "left")
    return best(first.drop("rank").union(searched(cut(rest)))).select("query_id", "rank", "vec_id", "score")
