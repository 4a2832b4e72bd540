"""Ordered analytics: latest rows, top-k, sessions, islands, baselines, smoothing, streaks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under `order`, which has to be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_k_per_group(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark trims each partition before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def sessionize(df: DataFrame, key: str, ts: str, gap_seconds: int, *ties: str, session: str = "session") -> DataFrame:
    """Numbers each key's sessions: a new one starts after a pause over `gap_seconds`."""
    w = Window.partitionBy(key).orderBy(ts, *ties)
    pause = epoch(ts) - F.lag(epoch(ts)).over(w)
    return df.withColumn("__new", F.coalesce((pause > gap_seconds).cast("int"), F.lit(0))).withColumn(session, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__new")


def islands(df: DataFrame, keys: list[str], order: str, flag: Column, island: str = "island") -> DataFrame:
    """Rows where `flag` holds, with a number for each unbroken run."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    start = F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False))
    return marked.withColumn(island, F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__f").drop("__f")


def seasonal_baseline(slots: DataFrame, keys: list[str], slot: str, value: str, period: int, n_back: int, least: int) -> DataFrame:
    """Median of the values 1 .. n_back periods before each slot, null with fewer than `least` of them; a join on the shifted slot."""
    past = slots.select(*keys, F.explode(F.array(*[F.col(slot) + k * period for k in range(1, n_back + 1)])).alias(slot), F.col(value).alias("__past"))
    base = past.groupBy(*keys, slot).agg(F.median("__past").alias("__m"), F.count("__past").alias("n_past"))
    out = slots.join(base, [*keys, slot], "left").withColumn("n_past", F.coalesce("n_past", F.lit(0)))
    return out.withColumn("baseline", F.when(F.col("n_past") >= least, F.col("__m"))).drop("__m")


def densify(counts: DataFrame, keys: list[str], day: str, value: str, step: str = "1 day") -> DataFrame:
    """Every step between the table's first and last day for every key, zero where nothing was counted."""
    bounds = counts.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(day))
    grid = days.crossJoin(counts.select(*keys).distinct()) if keys else days  # one row a day and key: the size of the result
    return grid.join(counts, [*keys, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def ewma(df: DataFrame, keys: list[str], order: str, value: str, half_life: float, name: str = "ewma") -> DataFrame:
    """Mean of all values so far, each halved in weight every `half_life` values; nulls are passed over.

    Running sums in blocks of 64 half-lives, weighted from the block's start,
    so weights stay below 2^64; beyond the block before, a value would weigh
    less than a double holds. No history is gathered.
    """
    size = math.ceil(64 * half_life)
    nth = F.count(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = df.withColumn("__i", nth).withColumns({"__b": F.floor(F.col("__i") / size), "__at": F.pmod(F.col("__i"), F.lit(size))})
    weighed = placed.withColumn("__w", F.when(F.col(value).isNotNull(), F.pow(F.lit(2.0), F.col("__at") / half_life)))
    here = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__b").rangeBetween(-1, -1)
    total = lambda c: F.sum(c).over(here) + F.coalesce(F.sum(c).over(before), F.lit(0.0)) * 2.0 ** (-size / half_life)
    told = weighed.withColumn(name, total(F.col(value) * F.col("__w")) / total(F.col("__w")))
    return told.drop("__i", "__b", "__at", "__w")


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[int(q*n)], clamped, of an array column."""
    s = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(s, F.least(F.floor(F.size(values) * F.lit(q)).cast("int") + 1, F.size(values))))


def values_at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bins: int = 1024) -> DataFrame:
    """The values at some ranks (1-based columns over n, the group's size) of each group, in sorted order.

    Values are counted before they are shuffled; the counts of `bins` ranges of
    values tell in which range a rank lies, and only that range is sorted. No
    task holds a group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    edges = counted.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.sum("__n").alias("n"))
    width = F.col("__high") - F.col("__low")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__low")) / width * bins))).otherwise(F.lit(0))
    ranged = counted.join(edges.select(*keys, "__low", "__high"), keys).withColumn("__bin", place).drop("__low", "__high")
    by = Window.partitionBy(*keys)
    sums = ranged.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__m"))
    upto = F.sum("__m").over(by.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumns({"__upto": upto, "n": F.sum("__m").over(by)}).withColumn("__before", F.col("__upto") - F.col("__m"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    asked = sums.withColumn("__q", asked).filter("__q.rank > __before AND __q.rank <= __upto").select(*keys, "__bin", "__before", "__q")
    fine = ranged.withColumn("__sum", F.sum("__n").over(Window.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    there = fine.join(asked, [*keys, "__bin"]).filter("__before + __sum - __n < __q.rank AND __q.rank <= __before + __sum")
    named = [F.max(F.when(F.col("__q.name") == name, F.col(value))).alias(name) for name in ranks]
    return there.groupBy(*keys).agg(*named)
