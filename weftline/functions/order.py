"""Exact order statistics of groups of any size, by histograms that are refined where the wanted ranks are.

A group's values are counted in equal bins between its least and largest; bins without a wanted rank are left, the others are
cut again between their own least and largest values, until a bin has few values or equal ones. Counts combine before they are
shuffled, so no task gets a group's values, whatever their number and distribution; only values of the last, small bins meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import checkpointed

#: Values of a bin that may meet in one task.
SMALL = 100_000
BINS = 1024
#: Rows of a table that is broadcast.
MOST_ROWS = 1_000_000


def sized_broadcast(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``MOST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: Callable[[Column], Column], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """``(by, n, found)``: of each group the number of values and a map from ranks (from 0) to the values there.

    ``ranks`` makes an array of ranks (long) of the number of values. NULL, NaN and infinite values take no part; groups
    with a NULL key do. A group whose array is empty has no row.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    data = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], v.alias("v")).where(F.abs("v") < F.lit(float("inf")))
    ends = data.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    ends = checkpointed(ends.withColumn("total", F.col("n")).withColumn("below", F.lit(0).cast("long")).withColumn("ranks", F.array_distinct(ranks(F.col("n")))).where(F.size("ranks") > 0))

    def within(some: DataFrame) -> DataFrame:
        own = some.select(*[F.col(k).alias(f"_{k}") for k in keys], "low", "high", "n", "total", "below", "ranks")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return data.join(sized_broadcast(own), same & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).drop(*[f"_{k}" for k in keys])

    open_, done = ends, None
    wide = (F.col("n") > small) & (F.col("low") < F.col("high"))
    while not open_.where(wide).isEmpty():
        narrow = open_.where(~wide)
        done = narrow if done is None else done.union(narrow)
        part = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        hist = within(open_.where(wide)).groupBy(*keys, "low", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin"))
        hist = hist.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("m"), F.first("total").alias("total"), F.first("below").alias("below"), F.first("ranks").alias("ranks"))
        before = F.sum("m").over(Window.partitionBy(*keys, "low").orderBy("bin")) - F.col("m")
        hist = hist.withColumn("below", F.col("below") + before)
        kept = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("m")))
        hist = hist.withColumn("ranks", kept).where(F.size("ranks") > 0)
        open_ = checkpointed(hist.select(*keys, F.col("least").alias("low"), F.col("most").alias("high"), F.col("m").alias("n"), "total", "below", "ranks"))
    done = open_ if done is None else done.union(open_)
    pair = lambda x: F.transform("ranks", lambda r: F.struct(r.alias("rank"), x(r).alias("v")))
    equal = done.where("low = high").select(*keys, "total", pair(lambda r: F.col("low")).alias("pairs"))
    few = within(done.where("low < high")).groupBy(*keys, "low").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("total").alias("total"), F.first("below").alias("below"), F.first("ranks").alias("ranks"))
    few = few.select(*keys, "total", pair(lambda r: F.get("vs", (r - F.col("below")).cast("int"))).alias("pairs"))
    every = equal.union(few).groupBy(*keys).agg(F.first("total").alias("n"), F.map_from_entries(F.flatten(F.collect_list("pairs"))).alias("found"))
    return every.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "found")


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """``(by, q)``: of each group the quantiles, interpolated between neighbouring values as ``percentile`` does."""

    def ranks(n: Column) -> Column:
        places = [p * (n - 1) for p in probs]
        return F.array(*[f(x).cast("long") for x in places for f in (F.floor, F.ceil)])

    stats = order_statistics(rows, by, value, ranks, small, bins)
    out = []
    for p in probs:
        at = p * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.col("found")[low.cast("long")], F.col("found")[high.cast("long")]
        out.append(F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b))
    return stats.select(*by, F.array(*out).alias("q"))


def cut_points(rows: DataFrame, by: list[str], value: str, small: int = SMALL) -> DataFrame:
    """``(by, cuts)``: for groups of more than ``small`` values, every ``small``-th value in order, without repeats."""
    step = F.lit(small).cast("long")
    none = F.array().cast("array<long>")
    stats = order_statistics(rows, by, value, lambda n: F.when(n > step, F.sequence(step, n - 1, step)).otherwise(none), small)
    return stats.select(*by, F.array_sort(F.array_distinct(F.map_values("found"))).alias("cuts"))


def part_of(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by halving; 0 where cuts are NULL."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(cuts)) & (F.get(cuts, at + s - 1) <= value), at + s).otherwise(at))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)
