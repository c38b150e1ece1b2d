"""Exact dedup with DataFrame functions only: a first pass fills a Bloom filter and finds what it meets twice, a second one
lets only rows that may be repeated shuffle; the rest pass straight through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, cut, fresh


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text (A-Z lower-cased, null as empty), as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def duplicate_decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays. A null id
    is below every other; rows that tie in text and id are marked alike. An empty table gives no rows. The text is read once;
    only (id, hash) of the possibly repeated rows shuffle, pre-aggregated by hash, so that one hot text is a row per task.
    """
    hashes = cut(df.select(F.col(id_col).alias(id_col), text_hash(F.col(text_col)).alias("__hash")))
    bits = bloom.size_for(hashes.count())
    flagged = bloom.flag(hashes, "__hash", cut(bloom.words(hashes, "__hash", bits, 2)), bits)
    alone = flagged.filter(~F.col("__maybe")).select(id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "__hash")
    maybe = flagged.filter("__maybe").drop("__maybe")
    # cut, so that both sides of the join shuffle, and the rows of a hot text can be split among tasks
    groups = cut(maybe.groupBy("__hash").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")))
    both = alone.unionByName(maybe.join(groups, "__hash").select(id_col, "keep_id", "group_size", "__hash"))
    return both.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("__hash")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all columns as they were: the one with the largest id.

    Rows that can't be repeated pass straight through. Of the others only (hash, id) is grouped, and the rows are matched on
    hash and id together, so that a text held by a third of all rows is no hot key. Rows that tie in id and text leave one.
    """
    h, key, keep, maybe = (fresh(df, f"__{name}") for name in ("hash", "id", "keep", "maybe"))
    hashed = df.withColumn(h, text_hash(F.col(text_col)))
    keys = cut(hashed.select(F.col(id_col).alias(key), h))
    bits = bloom.size_for(keys.count())
    table = cut(bloom.words(keys, h, bits, 2))
    stay = bloom.flag(keys, h, table, bits, maybe).filter(maybe).groupBy(F.col(h).alias(f"{h}g")).agg(F.max(key).alias(keep))
    flagged = bloom.flag(hashed, h, table, bits, maybe)
    chosen = flagged.filter(maybe).join(cut(stay), (F.col(h) == F.col(f"{h}g")) & F.col(id_col).eqNullSafe(F.col(keep)))
    chosen = chosen.dropDuplicates([h]).select(*df.columns)
    return flagged.filter(~F.col(maybe)).select(*df.columns).unionByName(chosen)
