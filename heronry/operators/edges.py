"""Measured edges of runs of low activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def trimmed(x: Column, y: Column, inner: Column) -> Column:
    """(x, y) moved to the inner times that stand closer than a quarter of the widest inner gap, from the left and then from the right."""
    ends = F.concat(F.array(x), inner, F.array(y))
    quarter = F.array_max(F.transform(F.slice(ends, 2, F.size(ends) - 1), lambda t, k: t - F.get(ends, k))) / 4.0

    def fold(values: Column, from_: Column, toward: int) -> Column:
        start = F.struct(from_.alias("edge"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

        def step(acc: Column, t: Column) -> Column:
            near = ~acc["stop"] & ((t - acc["edge"]) * toward < quarter)
            return F.struct(F.when(near, t).otherwise(acc["edge"]).alias("edge"), (acc["n"] + near.cast("int")).alias("n"), (~near).alias("stop"))

        return F.aggregate(values, start, step)

    left = fold(inner, x, 1)
    rest = F.slice(inner, left["n"] + 1, F.size(inner))
    return F.struct(left["edge"].alias("x"), fold(F.reverse(rest), y, -1)["edge"].alias("y"))


def refined_edges(runs: DataFrame, events: DataFrame, key: str, margin: int, least_share: float = 0.5) -> DataFrame:
    """`runs` (run, key, a, b, strays) with start, end and `measured`, from the events (key, at); times are whole seconds.

    The edges are the two events around the run that stand farthest apart with
    at most `strays` events between them, trimmed; they count if they cover
    enough of the run. Events meet runs by day, and the nearest events outside
    of a run's days come from a table of days, so no key's events are sorted.
    """
    days = events.groupBy(key, F.floor(F.col("at") / DAY).alias("d")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    days = days.groupBy(key).agg(F.collect_list(F.struct("d", "low", "high")).alias("days"))  # a row a day
    first, last = F.floor((F.col("a") - margin) / DAY), F.floor((F.col("b") + margin) / DAY)
    known = runs.join(days, key, "left").withColumns({
        "outer_low": F.array_max(F.transform(F.filter("days", lambda x: x["d"] < first), lambda x: x["high"])),
        "outer_high": F.array_min(F.transform(F.filter("days", lambda x: x["d"] > last), lambda x: x["low"])),
    }).drop("days")
    met = known.withColumn("d", F.explode(F.sequence(first, last))).join(events.withColumn("d", F.floor(F.col("at") / DAY)), [key, "d"])
    low, high = F.col("a") - margin, F.col("b") + margin
    around = met.groupBy("run").agg(F.max(F.when(F.col("at") < low, F.col("at"))).alias("near_low"), F.min(F.when(F.col("at") > high, F.col("at"))).alias("near_high"))
    ends = known.join(around, "run", "left").select("run", F.explode(F.array(F.coalesce("near_low", "outer_low"), F.coalesce("near_high", "outer_high"))).alias("at")).filter("at is not null")
    points = met.filter(F.col("at").between(low, high)).select("run", "at").unionByName(ends)
    w = Window.partitionBy("run").orderBy("at")
    placed = points.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("run"))}).join(runs.select("run", "strays"), "run")
    to = placed.select("run", F.col("i").alias("j"), F.col("at").alias("y"))
    pairs = placed.withColumn("j", F.least(F.col("i") + F.col("strays") + 1, F.col("n"))).filter("j > i").join(to, ["run", "j"])
    best = pairs.groupBy("run").agg(F.max_by(F.struct(F.col("at").alias("x"), "y"), F.struct(F.col("y") - F.col("at"), -F.col("i"))).alias("best"))
    inner = points.join(best, "run").filter((F.col("at") > F.col("best.x")) & (F.col("at") < F.col("best.y"))).groupBy("run").agg(F.array_sort(F.collect_list("at")).alias("inner"))  # at most `strays`
    told = best.join(inner, "run", "left").select("run", trimmed(F.col("best.x"), F.col("best.y"), F.coalesce("inner", F.array().cast("array<bigint>"))).alias("e"))
    over = F.least("e.y", "b") - F.greatest("e.x", "a")
    good = F.col("e").isNotNull() & F.coalesce(over >= least_share * (F.col("b") - F.col("a")), F.lit(False))
    return runs.join(told, "run", "left").select(*runs.columns, F.when(good, F.col("e.x")).otherwise(F.col("a")).alias("start"), F.when(good, F.col("e.y")).otherwise(F.col("b")).alias("end"), good.alias("measured"))
