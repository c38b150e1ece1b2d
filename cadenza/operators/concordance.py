"""Kendall's tau-b of two columns in each group, by inversions counted in blocks.

tau-b = (concordant - discordant) / sqrt(pairs not tied in a * pairs not tied in b). Ties come from counts of equal values. A pair is
discordant if its order by a is not its order by b. Both columns are cut into blocks: each edge value is a block of its own, and what lies
between two edges is one. A discordant pair lies in different blocks of both columns (counted from the grid of block sizes), or in
one block of a (counted inside that block), or in one block of b but not of a (counted inside that one). Blocks of a single value have
no such pairs, so a common value is no task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that lie between two edges, about, and the least and greatest number of edges: beyond 67M rows blocks grow with the group.
ROWS, EDGES, MOST_EDGES = 1 << 16, 64, 1024


def inversions(first: np.ndarray, second: np.ndarray) -> int:
    """Pairs with first[i] < first[j] and second[i] > second[j]."""
    y = np.unique(second, return_inverse=True)[1][np.lexsort((second, first))]
    total, width = 0, 1
    while width < len(y):  # merge runs of twice the width, all at once: a run's number, then the value
        run = np.arange(len(y)) // (2 * width)
        left = (np.arange(len(y)) // width) % 2 == 0
        m = int(y.max()) + 1
        key = run * m + y
        lefts = np.sort(key[left])
        ends = np.searchsorted(lefts, (run[~left] + 1) * m, "left")
        total += int((ends - np.searchsorted(lefts, key[~left], "right")).sum())
        y = np.sort(key) - run * m
        width *= 2
    return total


def _block(value: Column, edges: Column) -> Column:
    """2k + 1 at the k-th edge, 2k between it and the one before."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return (2 * below + F.array_contains(edges, value).cast("int")).cast("int")


def kendall(rows: DataFrame, by: str, a: str, b: str, edges: int | None = None) -> DataFrame:
    """(by, n, kendall): tau-b of each group's rows that have both columns; null where all pairs are tied in one of them. edges:
    how many values a column of a group is cut by, or as many as the largest group needs."""
    full = rows.select(F.col(by).alias("g"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    both = full.groupBy("g", "a", "b").agg(F.count("*").alias("n"))
    ties = lambda c, name: both.groupBy("g", c).agg(F.sum("n").alias("n")).groupBy("g").agg(pairs("n").alias(name))
    base = both.groupBy("g").agg(F.sum("n").alias("n"), pairs("n").alias("t3")).join(ties("a", "t1"), "g").join(ties("b", "t2"), "g")

    if edges is None:
        largest = base.agg(F.max("n")).first()[0] or 0
        edges = int(min(MOST_EDGES, max(EDGES, -(-largest // ROWS))))
    at = F.array([F.lit((i + 0.5) / edges) for i in range(edges)])
    cuts = full.groupBy("g").agg(*(F.array_distinct(F.percentile_approx(c, at, 100 * edges)).alias(f"e{c}") for c in "ab"))
    placed = full.join(cuts, "g").select("g", "a", "b", _block(F.col("a"), F.col("ea")).alias("i"), _block(F.col("b"), F.col("eb")).alias("j"))

    def grid(part: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((2 * edges + 2, 2 * edges + 2), np.int64)
        m[part["i"], part["j"]] = part["n"]
        after = m[::-1].cumsum(0)[::-1]  # rows of later blocks of a ...
        before = np.zeros_like(m)
        before[:, 1:] = after.cumsum(1)[:, :-1]  # ... in earlier blocks of b
        return pd.DataFrame({"g": part["g"].iloc[:1], "d": [int((m[:-1] * before[1:]).sum())]})

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": part["g"].iloc[:1], "d": [inversions(part["x"].to_numpy(), part["y"].to_numpy())]})

    kind = f"g {full.schema['g'].dataType.simpleString()}, d long"
    sizes = placed.groupBy("g", "i", "j").agg(F.count("*").alias("n"))
    found = sizes.groupBy("g").applyInPandas(grid, kind)
    several = lambda c: F.col(c) % 2 == 0
    one = placed.filter(several("i")).select("g", F.lit(0).alias("side"), F.col("i").alias("k"), F.col("a").alias("x"), F.col("b").alias("y"))
    two = placed.filter(several("j")).select("g", F.lit(1).alias("side"), F.col("j").alias("k"), F.col("i").cast("double").alias("x"), F.col("b").alias("y"))
    found = found.unionByName(one.unionByName(two).groupBy("g", "side", "k").applyInPandas(inside, kind))
    total = base.join(found.groupBy("g").agg(F.sum("d").alias("d")), "g")
    every = F.col("n") * (F.col("n") - 1) / 2
    scale = F.sqrt((every - F.col("t1")) * (every - F.col("t2")))
    tau = (every - F.col("t1") - F.col("t2") + F.col("t3") - 2 * F.col("d")) / F.nullif(scale, F.lit(0.0))
    return total.select(F.col("g").alias(by), F.col("n").cast("long").alias("n"), F.round(tau, 6).alias("kendall"))
