"""Movements and closures: legs, their classes, turns in place, missing traffic and its alerts, drops and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.operators.windows import epoch, islands, seasonal_baseline
from heronry.operators.joins import few
from heronry.plans.registry import query

HOUR = 3600
#: Height classes of the example: on the ground, low, high (fixed values).
PARKED, LOW, HIGH = 10.0, 30.0, 60.0

_S = "date_diff('second', TIMESTAMP '1970-01-01', ts)"
_LEGS = f"""p AS (SELECT user_id, event_id, event_type, value AS h, {_S} AS s, value < {PARKED} AS parked FROM events),
q AS (SELECT *, lag(s) OVER w AS s0, lag(h) OVER w AS h0, coalesce(lag(parked) OVER w, false) AS parked0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
r AS (SELECT *, last_value(CASE WHEN parked AND NOT parked0 THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS since FROM q),
m AS (SELECT *, CASE WHEN s0 IS NULL OR event_type = 'signup' OR s - s0 > {48 * HOUR} OR (s - s0 > {24 * HOUR} AND h < {LOW} AND h0 < {LOW}) OR (parked0 AND s - lag(since) OVER (PARTITION BY user_id ORDER BY s, event_id) > {12 * HOUR}) THEN 1 ELSE 0 END AS new FROM r),
legs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM m)"""


def legs(t) -> DataFrame:
    """Points (user_id, s, h, ..) with the leg they belong to.

    A leg begins at a mark, after a long gap, after a shorter gap with both ends
    low, and when a stay on the ground has lasted long enough.
    """
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = t.events.select("user_id", "event_id", "event_type", F.col("value").alias("h"), epoch("ts").alias("s"), (F.col("value") < PARKED).alias("parked"))
    p = p.withColumns({"s0": F.lag("s").over(w), "h0": F.lag("h").over(w), "parked0": F.coalesce(F.lag("parked").over(w), F.lit(False))})
    p = p.withColumn("since", F.last(F.when(F.col("parked") & ~F.col("parked0"), F.col("s")), ignorenulls=True).over(upto))
    gap, stay = F.col("s") - F.col("s0"), F.col("s") - F.lag("since").over(w)
    new = F.col("s0").isNull() | (F.col("event_type") == "signup") | (gap > 48 * HOUR) | ((gap > 24 * HOUR) & (F.col("h") < LOW) & (F.col("h0") < LOW)) | (F.col("parked0") & (stay > 12 * HOUR))
    return p.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("leg", F.sum("new").over(upto))


@query(f"WITH {_LEGS} SELECT user_id, leg::BIGINT AS leg, min(s)::BIGINT AS start, max(s)::BIGINT AS end_s, count(*)::BIGINT AS n FROM legs GROUP BY user_id, leg")
def trajectory_legs(t) -> DataFrame:
    return legs(t).groupBy("user_id", "leg").agg(F.min("s").alias("start"), F.max("s").alias("end_s"), F.count("*").alias("n"))


@query(f"""WITH {_LEGS}, c AS (SELECT user_id, leg, arg_min(h, (s, event_id)) AS first, arg_max(h, (s, event_id)) AS last, max(h) AS top, count(*) FILTER (new = 0 AND h0 >= {HIGH} AND h < {LOW}) AS downs, count(*) FILTER (new = 0 AND h0 < {LOW} AND h >= {HIGH}) AS ups, bool_or(h < {PARKED}) AS fixed FROM legs GROUP BY user_id, leg)
SELECT user_id, leg::BIGINT AS leg, CASE WHEN downs > 0 AND ups > 0 AND last >= {LOW} THEN 'go-around' WHEN first < {LOW} AND last < {LOW} AND top >= {HIGH} THEN 'hop' WHEN first < {LOW} AND last >= {LOW} THEN 'take-off' WHEN first >= {LOW} AND last < {LOW} THEN 'landing' WHEN top < {LOW} THEN 'ground' ELSE 'passing' END AS movement, NOT fixed AS estimated FROM c""")
def movement_classes(t) -> DataFrame:
    """Each leg's movement from its heights; estimated where no point is on the ground."""
    inside = F.col("new") == 0
    ends = [F.min_by("h", F.struct("s", "event_id")).alias("first"), F.max_by("h", F.struct("s", "event_id")).alias("last"), F.max("h").alias("top"), F.bool_or(F.col("h") < PARKED).alias("fixed")]
    turns = [F.count_if(inside & (F.col("h0") >= HIGH) & (F.col("h") < LOW)).alias("downs"), F.count_if(inside & (F.col("h0") < LOW) & (F.col("h") >= HIGH)).alias("ups")]
    c = legs(t).groupBy("user_id", "leg").agg(*ends, *turns)
    low_first, low_last = F.col("first") < LOW, F.col("last") < LOW
    movement = F.when((F.col("downs") > 0) & (F.col("ups") > 0) & ~low_last, "go-around").when(low_first & low_last & (F.col("top") >= HIGH), "hop").when(low_first & ~low_last, "take-off").when(~low_first & low_last, "landing").when(F.col("top") < LOW, "ground").otherwise("passing")
    return c.select("user_id", "leg", movement.alias("movement"), (~F.col("fixed")).alias("estimated"))


@query(f"""WITH h AS (SELECT user_id, event_id, {_S} AS s, event_id * 53 % 360 AS heading FROM events), d AS (SELECT *, coalesce((heading - lag(heading) OVER (PARTITION BY user_id ORDER BY s, event_id) + 540) % 360 - 180, 0) AS turn FROM h),
w AS (SELECT user_id, abs(sum(turn) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW)) AS turned, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW) AS n FROM d)
SELECT user_id, count(*) FILTER (turned >= 360 AND n >= 4)::BIGINT AS n_holding, max(turned)::BIGINT AS most FROM w GROUP BY user_id""")
def holding_turns(t) -> DataFrame:
    """Stretches of twelve hours in which the heading, unwrapped, turns a full circle or more."""
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    span = Window.partitionBy("user_id").orderBy("s").rangeBetween(-12 * HOUR, 0)
    h = t.events.select("user_id", "event_id", epoch("ts").alias("s"), (F.col("event_id") * 53 % 360).alias("heading"))
    d = h.withColumn("turn", F.coalesce((F.col("heading") - F.lag("heading").over(w) + 540) % 360 - 180, F.lit(0)))
    turned = d.select("user_id", F.abs(F.sum("turn").over(span)).alias("turned"), F.count("*").over(span).alias("n"))
    return turned.groupBy("user_id").agg(F.count_if((F.col("turned") >= 360) & (F.col("n") >= 4)).alias("n_holding"), F.max("turned").alias("most"))


_SLOT = 6 * HOUR
_CLOSURE = f"""c AS (SELECT event_type AS place, {_S} // {_SLOT} AS slot, count(*) AS k FROM events GROUP BY ALL), b AS (SELECT min(slot) AS a, max(slot) AS b FROM c),
g AS (SELECT place, slot, coalesce(k, 0) AS k FROM (SELECT DISTINCT place FROM c) CROSS JOIN (SELECT unnest(range(a, b + 1)) AS slot FROM b) LEFT JOIN c USING (place, slot)),
e AS (SELECT g.place, g.slot, any_value(g.k) AS k, CASE WHEN count(p.k) >= 3 THEN median(p.k) END AS expected FROM g LEFT JOIN g p ON p.place = g.place AND p.slot IN (g.slot - 4, g.slot - 8, g.slot - 12, g.slot - 16, g.slot - 20, g.slot - 24, g.slot - 28) GROUP BY 1, 2),
f AS (SELECT *, sum(k) OVER w / nullif(sum(expected) OVER w, 0) AS coverage FROM e WINDOW w AS (PARTITION BY place ORDER BY slot ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, coalesce(expected >= 2 AND k <= 0.5 * expected AND coverage BETWEEN 0.6 AND 1.4, false) AS signal FROM f)"""


def closure_signals(t) -> DataFrame:
    """Per place and slot: what passed, what was to be expected, how well the last day was covered, and whether traffic is missing."""
    counted = t.events.groupBy(F.col("event_type").alias("place"), F.floor(epoch("ts") / _SLOT).alias("slot")).agg(F.count("*").alias("k"))
    bounds = counted.agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    grid = bounds.select(F.explode(F.sequence("a", "b")).alias("slot")).crossJoin(F.broadcast(counted.select("place").distinct()))  # places by slots: the size of the result
    slots = grid.join(counted, ["place", "slot"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    known = seasonal_baseline(slots, ["place"], "slot", "k", 4, 7, 3).withColumnRenamed("baseline", "expected")
    w = Window.partitionBy("place").orderBy("slot").rowsBetween(-4, -1)
    covered = known.withColumn("coverage", F.sum("k").over(w) / F.nullif(F.sum("expected").over(w), F.lit(0.0)))
    return covered.withColumn("signal", F.coalesce((F.col("expected") >= 2) & (F.col("k") <= 0.5 * F.col("expected")) & F.col("coverage").between(0.6, 1.4), F.lit(False)))


@query(f"WITH {_CLOSURE} SELECT place, slot::BIGINT AS slot, k::BIGINT AS k, expected::DOUBLE AS expected, round(coverage, 6)::DOUBLE AS coverage FROM s WHERE signal")
def closure_signal(t) -> DataFrame:
    return closure_signals(t).filter("signal").select("place", "slot", "k", "expected", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {_CLOSURE}, l AS (SELECT place, slot, signal, coalesce(lag(signal) OVER (PARTITION BY place ORDER BY slot), false) AS before FROM s)
SELECT place, slot::BIGINT AS slot, CASE WHEN signal AND before THEN 'confirmed' WHEN signal THEN 'possible' ELSE 'resumed' END AS state FROM l WHERE signal OR before""")
def alert_life_cycle(t) -> DataFrame:
    """An alert is possible at its first slot, confirmed if it persists, resumed when traffic is back."""
    w = Window.partitionBy("place").orderBy("slot")
    told = closure_signals(t).withColumn("before", F.coalesce(F.lag("signal").over(w), F.lit(False))).filter("signal OR before")
    return told.select("place", "slot", F.when(F.col("signal") & F.col("before"), "confirmed").when(F.col("signal"), "possible").otherwise("resumed").alias("state"))


@query(f"""WITH {_CLOSURE}, i AS (SELECT place, slot, slot - row_number() OVER (PARTITION BY place ORDER BY slot) AS island FROM s WHERE signal), a AS (SELECT place, min(slot) * {_SLOT} AS alerted FROM i GROUP BY place, island),
n AS (SELECT event_type AS place, {_S} AS s FROM events WHERE value >= 60)
SELECT a.place, alerted::BIGINT AS alerted, min(n.s - alerted)::BIGINT AS lead_seconds FROM a LEFT JOIN n ON n.place = a.place AND n.s >= alerted AND n.s <= alerted + {48 * HOUR} GROUP BY ALL""")
def alert_lead_time(t) -> DataFrame:
    """From the start of each alert to the first news of its place within two days."""
    run = islands(closure_signals(t), ["place"], "slot", F.col("signal"))
    alerts = run.groupBy("place", "island").agg((F.min("slot") * _SLOT).alias("alerted"))
    day = lambda c: F.floor(c / (24 * HOUR))
    dealt = alerts.withColumn("day", F.explode(F.sequence(day(F.col("alerted")), day(F.col("alerted") + 48 * HOUR))))
    news = t.events.filter("value >= 60").select(F.col("event_type").alias("place"), epoch("ts").alias("s")).withColumn("day", day(F.col("s")))
    # Few alerts are broadcast, so that the news stay where they are.
    met = news.join(F.broadcast(dealt) if few(dealt) else dealt, ["place", "day"]).filter(F.col("s").between(F.col("alerted"), F.col("alerted") + 48 * HOUR))
    first = met.groupBy("place", "alerted").agg(F.min(F.col("s") - F.col("alerted")).alias("lead_seconds"))
    return alerts.select("place", "alerted").join(first, ["place", "alerted"], "left")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY ALL), l AS (SELECT user_id, list(v ORDER BY day) AS v FROM d GROUP BY 1 HAVING count(*) >= 6),
m AS (SELECT user_id, list_median(v[1:3]) AS first, list_median(v[len(v) - 2:]) AS last, len(list_filter(v, lambda x: x > 50)) AS n FROM l)
SELECT user_id, round(1 - last / first, 6) AS loss, n::BIGINT AS n_above FROM m WHERE last < 0.8 * first""")
def level_drop(t) -> DataFrame:
    """Sites whose last nights are well below their first ones, and how many nights are above a threshold."""
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    w = Window.partitionBy("user_id")
    placed = days.withColumns({"up": F.row_number().over(w.orderBy("day")), "down": F.row_number().over(w.orderBy(F.desc("day")))})
    side = lambda c: F.median(F.when(F.col(c) <= 3, F.col("v")))
    known = placed.groupBy("user_id").agg(side("up").alias("first"), side("down").alias("last"), F.count_if(F.col("v") > 50).alias("n_above"), F.count("*").alias("n"))
    return known.filter("n >= 6 AND last < 0.8 * first").select("user_id", F.round(1 - F.col("last") / F.col("first"), 6).alias("loss"), "n_above")


@query(f"""WITH c AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT *, n >= avg(n) OVER (PARTITION BY event_type) AS over, row_number() OVER (PARTITION BY event_type ORDER BY week DESC) AS back FROM c),
r AS (SELECT event_type, coalesce(min(back) FILTER (NOT over) - 1, max(back)) AS length, coalesce(sum(n) FILTER (back <= 2), 0) AS last, coalesce(sum(n) FILTER (back IN (3, 4)), 0) AS before FROM f GROUP BY 1)
SELECT event_type, length::BIGINT AS length, CASE WHEN last > before THEN 'rising' WHEN last < before THEN 'falling' ELSE 'steady' END AS trend FROM r""")
def streak_extent(t) -> DataFrame:
    """How many weeks the latest streak above the average lasts, and where its last two weeks go."""
    c = t.events.groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    f = c.withColumns({"over": F.col("n") >= F.avg("n").over(w), "back": F.row_number().over(w.orderBy(F.desc("week")))})
    total = lambda *backs: F.coalesce(F.sum(F.when(F.col("back").isin(*backs), F.col("n"))), F.lit(0))
    r = f.groupBy("event_type").agg(F.coalesce(F.min(F.when(~F.col("over"), F.col("back"))) - 1, F.max("back")).cast("long").alias("length"), total(1, 2).alias("last"), total(3, 4).alias("before"))
    return r.select("event_type", "length", F.when(F.col("last") > F.col("before"), "rising").when(F.col("last") < F.col("before"), "falling").otherwise("steady").alias("trend"))
