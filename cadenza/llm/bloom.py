"""A Bloom filter as a small table of 64-bit words, built and asked with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Two positions a key. BITS_PER_KEY bits a key up to MAX_BITS, which bounds the broadcast to 1/64 as many words of 16 bytes;
#: beyond that the filter gets denser, so that more rows are flagged: never a wrong answer, only less saved.
BITS_PER_KEY, MAX_BITS = 16, 1 << 26


def size_for(keys: int) -> int:
    return min(MAX_BITS, max(1 << 12, 1 << math.ceil(math.log2(max(1, keys) * BITS_PER_KEY))))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in (1, 2)]


def words(keys: DataFrame, key: str, bits: int, least: int = 1) -> DataFrame:
    """The positions that `least` rows or more hit, as (word, held): 64 positions a row, none without such positions."""
    hits = keys.select(F.explode(F.array_distinct(F.array(*_positions(F.col(key), bits)))).alias("pos"))
    often = hits.groupBy("pos").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return often.groupBy((F.col("pos") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("held"))


def flag(df: DataFrame, key: str, table: DataFrame, bits: int, out: str = "__maybe") -> DataFrame:
    """df and `out`: whether the filter holds both of the key's positions. The table has bits / 64 rows at most. Columns of df
    pass through, whatever their names, but one named `out`."""
    both, own = F.lit(True), fresh(df, "__bloom")
    for i, pos in enumerate(_positions(F.col(key), bits)):
        side = table.select(F.col("word").alias(f"{own}w{i}"), F.col("held").alias(f"{own}h{i}"))
        df = df.withColumn(f"{own}p{i}", pos).join(F.broadcast(side), (F.col(f"{own}p{i}") / 64).cast("long") == F.col(f"{own}w{i}"), "left")
        both = both & (F.getbit(F.coalesce(F.col(f"{own}h{i}"), F.lit(0).cast("long")), (F.col(f"{own}p{i}") % 64).cast("int")) == 1)
    return df.withColumn(out, both).drop(*(f"{own}{c}{i}" for i in (0, 1) for c in "pwh"))


def without(df: DataFrame, id_col: str, dropped: DataFrame, dropped_id: str) -> DataFrame:
    """df without the rows whose id is in `dropped`. Rows that the filter lets by don't shuffle; null ids stay."""
    gone, maybe = fresh(df, "__gone"), fresh(df, "__maybe")
    dropped = cut(dropped.select(F.col(dropped_id).alias(gone)).distinct())
    bits = size_for(dropped.count())
    table = cut(words(dropped, gone, bits))
    flagged = flag(df, id_col, table, bits, maybe)
    asked = flagged.filter(maybe).join(dropped, F.col(id_col) == F.col(gone), "left_anti")
    return flagged.filter(~F.col(maybe)).select(*df.columns).unionByName(asked.select(*df.columns))
