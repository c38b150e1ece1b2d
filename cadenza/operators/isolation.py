"""Anomalies by isolation trees: rows that few random cuts set apart from the others."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .quantiles import quantiles

#: Trees, rows a tree is grown on (about so many), share of the rows that count as anomalies.
TREES, ROWS, SHARE = 150, 256, 0.05


def expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth at which a search in a random tree of n rows fails."""
    n = np.asarray(n, float)
    more = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """(feature, cut, left child, depth where the path ends) of each node; a leaf has feature -1, right children follow left ones. Nodes
    are cut at random values of random columns that vary, down to the depth of a balanced tree."""
    rng, most = np.random.default_rng(seed), int(np.ceil(np.log2(max(2, len(x)))))
    feature, cut, left, end = [], [], [], []
    wait = [(x, 0)]
    while wait:
        rows, depth = wait.pop(0)
        low, high = rows.min(0), rows.max(0)
        varies = np.flatnonzero(high > low)
        leaf = depth >= most or len(rows) <= 1 or not len(varies)
        f = -1 if leaf else int(rng.choice(varies))
        c = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        feature.append(f)
        cut.append(c)
        left.append(0 if leaf else len(feature) + len(wait))
        end.append(depth + float(expected_depth(len(rows))) if leaf else 0.0)
        if not leaf:
            wait += [(rows[rows[:, f] < c], depth + 1), (rows[rows[:, f] >= c], depth + 1)]
    return np.array(feature), np.array(cut), np.array(left), np.array(end)


def depths(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Depth at which each row ends, and what a leaf of several rows adds."""
    feature, cut, left, end = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[at]
        go = f >= 0
        if not go.any():
            return end[at]
        at = np.where(go, left[at] + (x[rows, f] >= cut[at]), at)


def forest(rows: DataFrame, key: str, trees: int = TREES, size: int = ROWS) -> DataFrame:
    """(tree, rows, model): isolation trees of rows (key, features: array). Each is grown on a slot of about `size` rows: the rows are
    dealt to slots by a hash of the key, and dealt anew where there are fewer slots than trees. No row is in two slots of one deal."""
    n = rows.count()
    slots = max(1, n // size)
    deals = -(-trees // slots)
    deal = F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))
    slot = F.pmod(F.xxhash64(key, "deal"), F.lit(slots)) + F.col("deal") * slots
    dealt = rows.select(key, "features", deal.alias("deal")).select("features", slot.cast("int").alias("tree")).filter(F.col("tree") < trees)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["features"].to_numpy()).astype(float)
        x = x[np.lexsort(x.T[::-1])]  # the same tree whatever the order of the rows
        tree = int(part["tree"].iloc[0])
        return pd.DataFrame({"tree": [tree], "rows": [len(x)], "model": [pickle.dumps(grow(x, tree))]})

    return dealt.groupBy("tree").applyInPandas(fit, "tree int, rows int, model binary")


def isolation_scores(rows: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """(key, score): 2 to the power of minus the mean depth, as a share of the one expected; near 1 for rows soon set apart. The trees are
    broadcast: TREES trees of two nodes a row they were grown on, whatever the table."""
    held = model.orderBy("tree").collect()
    trees = rows.sparkSession.sparkContext.broadcast([pickle.loads(r["model"]) for r in held])  # noqa: S301
    typical = float(np.mean(expected_depth(np.array([r["rows"] for r in held])))) if held else 1.0
    kind = to_arrow_type(rows.schema[key].dataType)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            mean = sum(depths(t, x) for t in trees.value) / max(1, len(trees.value)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(2.0 ** (-mean / max(typical, 1e-9)))], names=[key, "score"])

    return rows.select(key, "features").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double")


def anomalies(rows: DataFrame, key: str, share: float = SHARE, trees: int = TREES, size: int = ROWS) -> DataFrame:
    """(key, decision, is_anomaly) of each row (key, features: array of numbers without nulls): decision is the threshold less the row's
    score, so that the `share` of rows that are soonest set apart lie below 0; the threshold is that exact quantile of all scores.
    An empty table gives no rows."""
    from .storage import cut

    scores = cut(isolation_scores(rows, key, forest(rows, key, trees, size)))
    limit = quantiles(scores.select((-F.col("score")).alias("s")), ["s"], [share]).select(F.col("q")[0].alias("offset")).withColumn("one", F.lit(1))
    both = scores.withColumn("one", F.lit(1)).join(F.broadcast(limit), "one").withColumn("decision", -F.col("score") - F.col("offset"))
    return both.select(key, "decision", (F.col("decision") < 0).alias("is_anomaly"))
