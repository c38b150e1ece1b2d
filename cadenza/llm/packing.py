"""Conflict-constrained best-fit packing of documents into training sequences.

Bins are kept in order of what room they have left, each with a bitmap of its sources and one of its duplicate clusters. A
document goes to the tightest bin that has room and holds neither its source nor its cluster: the search starts at the first
residual that suffices and moves on to the next larger one until a bin fits; else it opens a bin.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

CAPACITY = 2048
#: Pieces a shard is meant to hold. Shards are packed apart from each other, dealt by hash, so a hot source is spread evenly.
SHARD_PIECES = 4800


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item, items taken longest first (ties in the order given). Sources and clusters are small numbers; -1
    conflicts with nothing. No length is over capacity."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
    holding: dict[int, Counter] = defaultdict(Counter)  # by source, and by cluster (from -2 down): its bins, by residual
    filled = 0  # bit r: some bin has residual r
    by_source: list[int] = []
    by_cluster: list[int] = []
    members: list[set[int]] = []
    out = [0] * len(lengths)
    for i in order:
        n, source, cluster = lengths[i], sources[i], clusters[i]
        s_bit, c_bit = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        names = ([source] if source >= 0 else []) + ([-2 - cluster] if cluster >= 0 else [])
        found, r, rest = -1, n, filled >> n
        while rest:
            step = (rest & -rest).bit_length() - 1
            r, rest = r + step, rest >> step
            if all(len(at[r]) > holding[k][r] for k in names):
                found = next((k for k, b in enumerate(at[r]) if not by_source[b] & s_bit and not by_cluster[b] & c_bit), -1)
                if found >= 0:
                    break
            r, rest = r + 1, rest >> 1
        if found >= 0:
            b = at[r].pop(found)
            if not at[r]:
                filled ^= 1 << r
            for s in members[b]:
                holding[s][r] -= 1
            left = r - n
        else:
            b, left = len(members), capacity - n
            by_source.append(0)
            by_cluster.append(0)
            members.append(set())
        by_source[b] |= s_bit
        by_cluster[b] |= c_bit
        members[b].update(names)
        at[left].append(b)
        filled |= 1 << left
        for s in members[b]:
            holding[s][left] += 1
        out[i] = b
    return out


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """One row per piece: id, piece, n_pieces, n_tokens, shard, bin, bin_tokens; (shard, bin) names a sequence.

    A document over capacity is cut into full pieces and a rest, which must not share a bin (they are of one source and one
    cluster). Empty or null texts are one piece of length 0. A null source conflicts with nothing. Clusters are, unless given,
    documents of equal text but for A-Z's case; copies never share a bin. Repeated rows are packed as often as they occur;
    ties go by id, then piece. Other columns are left out; no rows: no bins.
    Shards hold SHARD_PIECES pieces or so, whatever the input, so no task holds more; only ids and numbers shuffle.
    """
    length = word_count(F.col(text_col)) if length is None else length
    cluster = F.xxhash64(ascii_lower(F.col(text_col))) if cluster is None else cluster
    sized = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), length.alias("n"))
    n_pieces = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / capacity))
    sized = cut(sized)
    shards = max(1, round((sized.agg(F.sum(n_pieces)).first()[0] or 0) / SHARD_PIECES))
    pieces = sized.withColumn("n_pieces", n_pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long")).drop("n")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        sources, _ = pd.factorize(pdf["source"])
        cluster_of, _ = pd.factorize(pdf["cluster"])
        often = np.bincount(cluster_of, minlength=1)[cluster_of] > 1
        numbers, _ = pd.factorize(pd.Series(np.where(often, cluster_of, -1)))
        lone = np.where(often, numbers, -1)
        pdf["bin"] = best_fit(pdf["n_tokens"].tolist(), sources.tolist(), lone.tolist(), capacity)
        pdf["bin_tokens"] = pdf.groupby("bin")["n_tokens"].transform("sum")
        return pdf[["id", "piece", "n_pieces", "n_tokens", "shard", "bin", "bin_tokens"]]

    kind = df.schema[id_col].dataType.simpleString()
    packed = pieces.groupBy("shard").applyInPandas(run, "id string, piece long, n_pieces long, n_tokens long, shard long, bin long, bin_tokens long")
    return packed.select(F.col("id").cast(kind).alias(id_col), *packed.columns[1:])
