"""Exact quantiles of columns and groups of any size, without a task that holds a column.

Small groups use Spark's own percentile. In a large one each wanted rank is narrowed down: a sketch gives values that lie just
below and above the rank, one pass counts what lies below, at and between them, and so on until the rank falls on one of
the two values or few rows are left between them. A rank's rows shrink by a factor of about ACCURACY / 4 a round, whatever the values;
equal values never have to be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Rows of a group that one task may hold; the sketch's accuracy (its ranks are off by one row in so many at most); large groups
#: and ranks that are broadcast at most.
FEW, ACCURACY, MOST = 1 << 16, 10_000, 20_000


def _wanted(n: Column, share: Column) -> Column:
    """The two ranks, from 0, between which a share lies, and how far it is from the first."""
    at = (n - 1) * share
    return F.struct(F.floor(at).alias("r0"), F.ceil(at).alias("r1"), (at - F.floor(at)).alias("part"))


def selected(values: DataFrame, ranks: DataFrame, keys: list[str], few: int, accuracy: int) -> DataFrame:
    """(keys, rank, value): the rank-th least value, from 0, of each key's rows. values: keys, value; ranks: keys, rank. A pass serves all
    ranks of a key that lie between the same two values."""
    v = F.col("value")
    small = F.broadcast if ranks.count() <= MOST else lambda df: df
    counts = ["below", "at", "between"]  # tell the ranges of a key apart
    span = ["lo", "hi", *counts]
    inside = F.coalesce(v > F.col("lo"), F.lit(True)) & F.coalesce(v < F.col("hi"), F.lit(True))  # null: no end yet

    def counted(open_: DataFrame) -> DataFrame:
        """open_ (keys, rank, lo, hi) with the numbers of rows below lo, at lo, between both, and at hi."""
        met = values.join(small(open_.select(*keys, "lo", "hi").distinct()), keys)
        sums = met.groupBy(*keys, "lo", "hi").agg(F.count_if(v < F.col("lo")).alias("below"), F.count_if(v == F.col("lo")).alias("at"), F.count_if((v > F.col("lo")) & (v < F.col("hi"))).alias("between"), F.count_if((v == F.col("hi")) & (v > F.col("lo"))).alias("top"))
        return cut(open_.join(sums, [*keys, "lo", "hi"]))

    sizes = values.groupBy(*keys).agg(F.count("*").alias("between"))
    none = [F.lit(None).cast("double").alias(c) for c in ("lo", "hi")]
    nought = [F.lit(0).cast("long").alias(c) for c in ("below", "at", "top")]
    state, done, error = cut(ranks.join(sizes, keys).select(*keys, "rank", *none, *nought, "between")), None, 2 / accuracy
    while True:
        first, last = F.col("below") + F.col("at"), F.col("below") + F.col("at") + F.col("between")
        found = state.filter((F.col("rank") < first) | (F.col("rank") >= last)).select(*keys, "rank", F.when(F.col("rank") < first, F.col("lo")).otherwise(F.col("hi")).alias("value"))
        done = found if done is None else done.unionByName(found)
        state = state.filter((F.col("rank") >= first) & (F.col("rank") < last))
        rest = state.filter(F.col("between") > few)
        last_few = state.filter(F.col("between") <= few)
        if not last_few.isEmpty():
            listed = values.join(small(last_few.select(*keys, *span).distinct()), keys).filter(inside).groupBy(*keys, *counts).agg(F.array_sort(F.collect_list("value")).alias("all"))
            place = (F.col("rank") - F.col("below") - F.col("at")).cast("int")
            done = done.unionByName(last_few.join(listed, [*keys, *counts]).select(*keys, "rank", F.get("all", place).alias("value")))
        if rest.isEmpty():
            return done
        # values a little to both sides of the rank, among those between
        met = values.join(small(rest.select(*keys, *span).distinct()), keys).filter(inside)
        sketch = met.groupBy(*keys, *counts).agg(F.percentile_approx(v, F.array([F.lit(i / 1000) for i in range(1001)]), accuracy).alias("edges"))
        share = (F.col("rank") - F.col("below") - F.col("at")) / F.col("between") * 1000
        edge = lambda at: F.get("edges", F.greatest(F.lit(0), F.least(F.lit(1000), at)).cast("int"))
        near = cut(rest.select(*keys, "rank", *counts).join(sketch, [*keys, *counts]).select(*keys, "rank", edge(F.floor(share - 1000 * error)).alias("lo"), edge(F.ceil(share + 1000 * error)).alias("hi")))
        fresh = counted(near)
        # a rank outside what the sketch gave (it should not be) keeps its old ends, and takes wider ones next time
        outside = (F.col("rank") < F.col("below")) | (F.col("rank") >= F.col("below") + F.col("at") + F.col("between") + F.col("top"))
        lost = fresh.filter(outside).select(*keys, "rank")
        state = fresh.filter(~outside)
        if not lost.isEmpty():
            error *= 2
            state = cut(state.unionByName(rest.join(lost, [*keys, "rank"], "left_semi")))


def _plain(df: DataFrame, columns: list[str], shares: list[float], by: list[str]) -> DataFrame:
    """The quantiles of groups that fit a task: a sorted list a column and group, all columns of a row at once."""
    lists = df.groupBy(*by).agg(*(F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(f"v{i}") for i, c in enumerate(columns)))

    def at(v: Column, share: float) -> Column:
        w = _wanted(F.size(v), F.lit(share))
        a, b = F.get(v, w["r0"].cast("int")), F.get(v, w["r1"].cast("int"))
        return F.when(w["part"] == 0, a).otherwise(a * (1 - w["part"]) + b * w["part"])

    q = lambda v: F.when(F.size(v) > 0, F.array(*(at(v, s) for s in shares)))
    named = F.array(*(F.struct(F.lit(c).alias("feature"), q(F.col(f"v{i}")).alias("q")) for i, c in enumerate(columns)))
    return lists.select(*by, F.explode(named).alias("x")).select(*by, "x.feature", "x.q")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None, few: int = FEW, accuracy: int = ACCURACY, most: int | None = None, written: bool = False) -> DataFrame:
    """(by, feature, q): the quantiles of each column in each group, by linear interpolation; nulls don't count, and a column without
    values has null quantiles. Null keys are a group of their own. Same results as `percentile`, for groups of any size. most: rows that df has at most, if that
    is known; written: df is read from where it was written, so it is not written again."""
    by = by or []
    df = df.select(*by, *columns)
    if not written and (most is None or most > few):
        df = cut(df)  # every round reads it
    long = df.unpivot(by, columns, "feature", "value").withColumn("value", F.col("value").cast("double"))
    keys = [*by, "feature"]
    plain = F.percentile("value", F.array(*map(F.lit, shares))).alias("q")
    if most is not None and most <= few:
        return long.groupBy(*keys).agg(plain)
    wide = df.groupBy(*by).agg(*(F.count(c).alias(c) for c in columns))
    sizes = wide.unpivot(by, columns, "feature", "n")
    large = sizes.filter(F.col("n") > few)
    large = cut(large) if by else large
    if large.isEmpty():
        return _plain(df, columns, shares, by)
    # keys become one number, so that null keys meet, too
    number = F.xxhash64(*keys, *(F.col(c).isNull() for c in by)).alias("key")
    mark = large.select(number, *keys, "n")
    apart = long.withColumn("key", F.xxhash64(*keys, *(F.col(c).isNull() for c in by)))
    rest = apart.join(F.broadcast(mark.select("key")), "key", "left_anti").groupBy(*keys).agg(plain)
    values = apart.join(F.broadcast(mark.select("key")), "key", "left_semi").filter("value is not null").select("key", "value")
    wanted = mark.select("key", *keys, F.posexplode(F.array(*(_wanted(F.col("n"), F.lit(s)) for s in shares))).alias("i", "w"))
    ranks = cut(wanted.select("key", F.explode(F.array("w.r0", "w.r1")).alias("rank")).distinct())
    found = cut(selected(values, ranks, ["key"], few, accuracy))
    a, b = found.toDF("key", "r0", "v0"), found.toDF("key", "r1", "v1")
    placed = wanted.select("key", *keys, "i", "w.*").join(a, ["key", "r0"]).join(b, ["key", "r1"])
    value = F.when(F.col("part") == 0, F.col("v0")).otherwise(F.col("v0") * (1 - F.col("part")) + F.col("v1") * F.col("part"))
    listed = placed.groupBy("key", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("q"))
    return listed.select(*keys, "q").unionByName(rest)


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None, few: int = FEW, most: int | None = None) -> DataFrame:
    """(by, columns): medians by group, a column for each; one row without groups."""
    by = by or []
    if most is not None and most <= few:
        return df.groupBy(*by).agg(*(F.median(c).alias(c) for c in columns))
    found = quantiles(df, columns, [0.5], by, few, most=most)
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in columns))
    return wide


def counted_quantiles(counts: DataFrame, value: str, shares: list[float], by: list[str], n: str = "n") -> DataFrame:
    """(by, n, q): quantiles of a column of few distinct values from how often each occurs, as quantiles() gives them of the rows, and the number
    of rows. counts: by, value (no nulls), n."""
    each = Window.partitionBy(*by)
    upto = F.sum(n).over(each.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*by, F.col(value).cast("double").alias("v"), F.col(n).alias("m"), upto.alias("upto"), F.sum(n).over(each).alias("n"))
    at = lambda r: F.max(F.when((F.col("upto") - F.col("m") <= r) & (r < F.col("upto")), F.col("v")))
    wanted = [_wanted(F.col("n"), F.lit(s)) for s in shares]
    ends = placed.groupBy(*by, "n").agg(*(at(w[r]).alias(f"{r}_{i}") for i, w in enumerate(wanted) for r in ("r0", "r1")))
    mixed = [F.when(w["part"] == 0, F.col(f"r0_{i}")).otherwise(F.col(f"r0_{i}") * (1 - w["part"]) + F.col(f"r1_{i}") * w["part"]) for i, w in enumerate(wanted)]
    return ends.select(*by, "n", F.array(*mixed).alias("q"))
