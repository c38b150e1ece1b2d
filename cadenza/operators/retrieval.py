"""Top-k retrieval, genre zones and diverse selection, for many requests at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import distance


#: Requests of a block; rows of the corpus and requests of it that are multiplied at a time.
REQUESTS, ROWS, SOME = 4096, 256, 512


def best_products(corpus: DataFrame, requests: DataFrame, k: int, same: bool = False, apart: bool = False, without: DataFrame | None = None, within: bool = False) -> DataFrame:
    """(request_id, track_id, score, rank): the k rows of the corpus with the largest products of unit vectors, within 0..1, for each
    request; ties by track_id. corpus: track_id, v, part; requests: request_id, v, part; v: array<double>, all of one length. With `same`
    only rows of the request's part count, with `apart` only rows of other parts (part: a long); with `within` a request's part is a bitmap
    of the parts, 0 to 62, that count, and -1 stands for all. without: pairs (request_id, track_id) that don't count.

    Blocks of requests and shares of the corpus meet as rows in tasks: a request goes to each share once, a row of the corpus to each
    block of REQUESTS requests, a pair of `without` to the one place where both are. There are as many shares as make the tasks busy. A task
    holds a block, multiplies matrices with the rows that stream by, and passes on k rows a request. Only products that can still be among
    the k best are rounded and kept. The driver gets the number of requests.
    """
    request_type, track_type = requests.schema["request_id"].dataType, corpus.schema["track_id"].dataType
    schema = f"request_id {request_type.simpleString()}, track_id {track_type.simpleString()}, score double"
    requests_type, tracks_type = to_arrow_type(request_type), to_arrow_type(track_type)
    tasks = 3 * corpus.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-requests.count() // REQUESTS))
    shares = max(1, -(-tasks // blocks))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = lambda df, block, share, side: df.select(block.alias("block"), share.alias("share"), F.lit(side).alias("side"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("request_id", request_type), ("track_id", track_type), ("v", "array<double>"), ("part", "long"))))
    asked = row(requests.select("request_id", "v", "part", each(shares).alias("s")), number("request_id", blocks), F.col("s"), 0)
    rows = row(corpus.select("track_id", "v", "part", each(blocks).alias("b")), F.col("b"), number("track_id", shares), 2)
    met = asked.unionByName(rows)
    if without is not None:
        met = met.unionByName(row(without.select(F.col("request_id").cast(request_type), F.col("track_id").cast(track_type)), number("request_id", blocks), number("track_id", shares), 1))
    met = met.repartitionById(blocks * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions("block", "share", "side")

    def unit(column: pa.ListArray) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    class Block:
        def __init__(self):
            self.ids, self.q, self.part, self.skip, self.kept, self.size = [], [], [], {}, [], 0

        def start(self):
            if isinstance(self.q, list):
                self.q, self.part = np.concatenate(self.q), np.concatenate(self.part)
                self.limit, self.place = np.full(len(self.ids), -1.0), {}
                self.product, self.barred = np.empty((SOME, ROWS)), np.zeros((len(self.ids), ROWS), bool)

        def best(self):
            at, item, score = (np.concatenate(c) for c in zip(*self.kept, strict=True))
            order = np.lexsort((item, -score, at))
            at, item, score = at[order], item[order], score[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            last = rank == k - 1
            self.limit[at[last]] = score[last]
            self.kept = [[c[rank < k] for c in (at, item, score)]]
            self.size = len(self.kept[0][0])

        def meet(self, items: np.ndarray, x: np.ndarray, parts: np.ndarray):
            for i in range(0, len(items), ROWS):
                here = slice(i, i + ROWS)
                n, floor = len(items[here]), np.where(self.limit > 0, self.limit - 1e-9, -np.inf)
                gone = [(c, self.skip[item]) for c, item in enumerate(items[here].tolist()) if item in self.skip] if self.skip else []
                for c, without_ in gone:
                    self.barred[without_, c] = True
                for a in range(0, len(self.ids), SOME):
                    some = slice(a, a + SOME)
                    s = np.matmul(self.q[some], x[here].T, out=self.product[: len(self.q[some]), :n] if n == ROWS else None)
                    # a product this far below the limit can't round to it
                    good = s >= floor[some, None]
                    if gone:
                        good &= ~self.barred[some, :n]
                    if same or apart:
                        good &= (self.part[some, None] == parts[None, here]) == same
                    if within:
                        good &= (self.part[some, None] >> np.where(parts[here] < 0, 63, parts[here])[None] & 1) == 1
                    at, c = np.nonzero(good)
                    score = np.round(np.clip(s[at, c], 0, 1), 9)
                    kept = score >= self.limit[a + at]
                    self.kept.append([a + at[kept], items[i + c[kept]], score[kept]])
                    self.size += int(kept.sum())
                for c, without_ in gone:
                    self.barred[without_, c] = False
                if self.size > 2 * k * len(self.ids) + 100_000:
                    self.best()

        def found(self):
            if self.size:
                self.best()
                at, item, score = self.kept[0]
                yield pa.RecordBatch.from_arrays([pa.array([self.ids[a] for a in at], requests_type), pa.array(item.tolist(), tracks_type), pa.array(score)], names=["request_id", "track_id", "score"])

    def run(batches):
        key, block = None, Block()
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero(np.r_[True, (places[:, 1:] != places[:, :-1]).any(0)]) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if (places[0, a], places[1, a]) != key:
                    yield from block.found()
                    key, block = (places[0, a], places[1, a]), Block()
                some = batch.slice(a, b - a)
                if places[2, a] == 0:
                    block.ids += some.column(3).to_pylist()
                    block.q.append(unit(some.column(5)))
                    block.part.append(some.column(6).fill_null(-1).to_numpy())
                elif block.ids:
                    block.start()
                    if places[2, a] == 1:
                        block.place = block.place or {r: i for i, r in enumerate(block.ids)}
                        for r, t in zip(some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True):
                            if r in block.place:
                                block.skip.setdefault(t, []).append(block.place[r])
                    else:
                        block.meet(np.array(some.column(4).to_pylist()), unit(some.column(5)), some.column(6).fill_null(-1).to_numpy())
        yield from block.found()

    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "track_id")
    return met.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar(corpus: DataFrame, requests: DataFrame, features: list[str], k: int, weights: list[float] | None = None, without: DataFrame | None = None) -> DataFrame:
    """The k rows of the corpus most similar to each request's vector (missing values 0, weights below 0 as 0); ties by track_id.
    requests: request_id and the features; without: pairs (request_id, track_id) that don't count."""
    scale = [max(0.0, w) ** 0.5 for w in weights or [1.0] * len(features)]
    vector = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in zip(features, scale, strict=True))).alias("v")
    rows = corpus.select("track_id", vector, F.lit(0).cast("long").alias("part"))
    return best_products(rows, requests.select("request_id", vector, F.lit(0).cast("long").alias("part")), k, without=without)


def resolved(seeds: DataFrame, corpus: DataFrame, features: list[str]) -> DataFrame:
    """seeds (seed_id and others) with the features of the track of that id, missing ones 0; known: whether there is one, and problem: what
    is wrong with the seed."""
    rows = seeds.join(corpus.select(F.col("track_id").alias("seed_id"), *features, F.lit(True).alias("__hit")), "seed_id", "left")
    problem = F.when(F.col("__hit").isNull(), F.concat(F.lit("unknown id "), F.coalesce(F.col("seed_id").cast("string"), F.lit(""))))
    return rows.select(*seeds.columns, F.isnotnull("__hit").alias("known"), problem.alias("problem"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in features))


def within_radius(corpus: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Rows of the corpus within the radius of each centre (name, top0, left0), with their distance. Both sides are put on a grid
    of that width; a centre looks into nine cells, so that the join is one of equal keys."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    spread = centres.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    spread = spread.select("name", "top0", "left0", (cell("top0") + F.col("dx")).alias("cx"), (cell("left0") + F.col("dy")).alias("cy"))
    placed = corpus.filter("top is not null and left is not null").withColumn("cx", cell("top")).withColumn("cy", cell("left"))
    found = placed.join(spread, ["cx", "cy"]).withColumn("enoa_distance", distance(F.col("top"), F.col("left"), F.col("top0"), F.col("left0")))
    return found.filter(F.col("enoa_distance") <= radius).drop("cx", "cy", "top0", "left0")


def cluster_diverse(scored: DataFrame, k: int, n_clusters: int) -> DataFrame:
    """k rows a request: first at most max(1, k // n_clusters) of each cluster by score, then the best of the rest."""
    order = [F.desc("score"), F.col("track_id")]
    share = max(1, k // n_clusters)
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("request_id", "cluster_id").orderBy(*order)))
    placed = placed.withColumn("pick", F.row_number().over(Window.partitionBy("request_id").orderBy((F.col("place") > share).cast("int"), *order)))
    return placed.filter(F.col("pick") <= k).drop("place", "pick")
