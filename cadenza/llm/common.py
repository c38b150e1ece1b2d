"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty. Pure ASCII texts take the fast built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that starts with `name` and begins none of df's own, whatever their case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def used_up(*frames: DataFrame) -> None:
    """Deletes the checkpoints of frames that nothing needs any more, and lets the driver collect its garbage, so that Spark drops the
    shuffle files of finished steps now instead of when the driver's memory happens to fill."""
    gc.collect()
    for df in frames:
        jvm, plan = df.sparkSession.sparkContext._jvm, df._jdf.queryExecution().logical()
        path = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if path is not None and path.isDefined():
            at = jvm.org.apache.hadoop.fs.Path(path.get())
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    SparkSession.getActiveSession().sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that the session has set. Only a local session may do without one: a
    cluster's executors can't see each other's own folders, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cadenza-checkpoints"))
    return sc.getCheckpointDir()


def merged_table(df: DataFrame, make, cells: int, dtype: str, how: str, chunk: int = 1 << 16) -> np.ndarray:
    """One array of `cells` numbers, merged from one array a task; its size is fixed, whatever the input.

    make(batches) -> array of that size and dtype, called once in each task. The arrays go, in compressed chunks, to a few
    tasks that merge them as they stream in ("add" saturates at the dtype's largest value; "or"), so that a task holds no
    more than the table itself. The driver gets `cells` numbers.
    """
    chunk = min(chunk, cells)
    top = np.iinfo(dtype).max

    def split(batches):
        whole = make(batches)
        for i in range(0, cells, chunk):
            part = whole[i : i + chunk]
            if part.any():
                yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int64()), "part": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(part), dtype)
                if at not in sums:
                    sums[at] = new.copy()
                elif how == "or":
                    sums[at] |= new
                else:
                    old = sums[at]
                    sums[at] = old + np.minimum(new, top - old)
        for at, part in sums.items():
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "part": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    schema = "at long, part binary"
    parts = df.mapInArrow(split, schema)
    n = max(1, min(-(-cells // chunk), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros(cells, dtype)
    for at, part in parts.repartition(n, "at").mapInArrow(merge, schema).collect():
        new = np.frombuffer(zlib.decompress(bytes(part)), dtype)
        out[at : at + len(new)] = new
    return out
