"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as those given: stars, with the least node of each in the middle (first)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    rest = root != np.arange(len(nodes))
    return nodes[root[rest]], nodes[rest]


def _forest(batches):
    """Replaces a batch's links by stars."""
    for batch in batches:
        a, b = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


def components(links: DataFrame) -> DataFrame:
    """links: two long columns. (node, component) of every linked node but the least of its component, which is `component`.

    Each round groups a node's neighbours only to their least (pre-aggregated) and joins it back, so a node with very many
    links is no task of its own. Rounds grow with the logarithm of the longest path; each ends in a checkpoint. Nulls and
    links of a node to itself are left out; no links give no rows.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    edges = cut(edges.mapInArrow(_forest, "a long, b long").distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node gets the least of the node and its neighbours
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.filter("v > u").join(least, "u").select("m", "v").toDF("a", "b").distinct()
        # small star: a node and its smaller neighbours get the least of them
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        moved = edges.join(least, "b")
        edges = cut(moved.select("m", "a").filter("m <> a").union(least.select("m", "b")).toDF("a", "b").distinct())
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = state
