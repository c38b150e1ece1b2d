"""Reports over the library: distributions, outliers, coverage, centroids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import MOST, quantiles
from .storage import cut


def histogram(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Rows in each of `bins` equal intervals between a column's least and greatest value (the last one closed); nulls are left out,
    a constant column falls into bin 0."""
    long = df.unpivot([], columns, "feature", "value").filter("value is not null")
    bounds = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    bin_of = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return long.join(F.broadcast(bounds), "feature").groupBy("feature", bin_of.alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls, mean, std (n - 1), min, quartiles and max of each column."""
    out = df.unpivot([], columns, "feature", "value").groupBy("feature").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    ).join(quantiles(df, columns, [0.25, 0.5, 0.75]), "feature", "left")
    r = lambda c, name: F.round(c, 6).alias(name)
    return out.select("feature", "n", "nulls", r("mean", "mean"), r("std", "std"), r("low", "low"), *(r(F.col("q")[i], f"q{i + 1}") for i in range(3)), r("high", "high"))


def centroid_outliers(rows: DataFrame, by: str, columns: list[str], share: float = 0.95) -> DataFrame:
    """Distance of each row from its group's mean in standard deviations, and whether it lies beyond the group's `share` quantile.
    Missing values add nothing; a deviation below 1e-9 counts as 1e-9. Groups are aggregated and joined, never held whole. rows are read
    twice; what is written is distances without the columns. Returns the rows' other columns, distance and is_outlier."""
    stats = rows.groupBy(by).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns))
    z = [F.coalesce(F.pow((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.coalesce(f"s_{c}", F.lit(0.0)), F.lit(1e-9)), 2), F.lit(0.0)) for c in columns]
    kept = [c for c in rows.columns if c not in columns]
    stats = cut(stats)
    small = F.broadcast if stats.count() <= MOST else lambda df: df  # so that rows don't travel with all their columns
    scored = cut(rows.join(small(stats), by).select(*kept, F.round(F.sqrt(reduce(lambda a, b: a + b, z)), 6).alias("distance")))
    limit = quantiles(scored, ["distance"], [share], [by], written=True).select(by, F.col("q")[0].alias("limit"))
    return scored.join(small(limit), by).select(*kept, "distance", (F.col("distance") > F.col("limit")).alias("is_outlier"))


def share_pivot(rows: DataFrame, by: str, value: str, values: list[str]) -> DataFrame:
    """Each group's share of every value; a group without any gives zeros."""
    counts = rows.groupBy(by).pivot(value, values).agg(F.count(F.lit(1))).fillna(0)
    total = F.greatest(F.lit(1), reduce(lambda a, b: a + b, (F.col(f"`{v}`") for v in values)))
    return counts.select(by, *(F.round(F.col(f"`{v}`") / total, 6).alias(v) for v in values))


def density_grid(df: DataFrame, x: str, y: str, cells: int = 20) -> DataFrame:
    """Rows in each cell of a square grid over the bounding box; rows without coordinates are left out."""
    placed = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    box = placed.agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max)))).withColumn("one", F.lit(1))
    cell = lambda c: F.least(F.coalesce(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    return placed.withColumn("one", F.lit(1)).join(F.broadcast(box), "one").groupBy(cell(x).alias("cx"), cell(y).alias("cy")).agg(F.count("*").alias("n"))


def centroid_distances(df: DataFrame, by: str, x: str, y: str, least: int = 5, most: int = 15) -> DataFrame:
    """Distances between the centres of the `most` largest groups of at least `least` rows (ties by name)."""
    centres = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))
    centres = centres.filter(F.col("n") >= least).orderBy(F.desc("n"), by).limit(most).select(by, "x", "y")
    a, b = centres.toDF("a", "xa", "ya"), centres.toDF("b", "xb", "yb")
    apart = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(apart, 6).alias("distance"))


def rank_shift(before: DataFrame, after: DataFrame, by: str, key: str) -> DataFrame:
    """How far rows moved between two rankings (columns by, key, rank): mean, greatest rise and fall, and rows that kept their place."""
    both = before.select(by, key, F.col("rank").alias("r0")).join(after.select(by, key, F.col("rank").alias("r1")), [by, key])
    up = F.col("r0") - F.col("r1")
    return both.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(up)), 6).alias("mean_shift"), F.max(up).cast("long").alias("max_rise"), F.max(-up).cast("long").alias("max_fall"), F.count_if(up == 0).alias("unchanged"))


def rank_correlation(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Spearman's correlation of two columns in each group, ties at their mean rank. Ranks come from counts of distinct values."""
    def ranked(c: str) -> DataFrame:
        n = rows.groupBy(by, c).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return n.select(by, c, (upto - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    full = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = full.select(by, a, b)
    return rows.join(ranked(a), [by, a]).join(ranked(b), [by, b]).groupBy(by).agg(F.count("*").alias("n"), F.round(F.corr(f"rank_{a}", f"rank_{b}"), 6).alias("spearman"))


def coverage(df: DataFrame, by: str, present: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.count_if(present) * 100 / F.count("*"), 4).alias("pct"))
