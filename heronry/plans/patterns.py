"""Edges of low runs, covers by circles, regressions of several features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.geo import synthetic_lat, synthetic_lon
from heronry.operators.covers import circle_cover
from heronry.operators.edges import refined_edges
from heronry.operators.holding import Network, holding_windows, holdings
from heronry.operators.merges import merge_in_order, resolve_overlaps
from heronry.operators.nearby import near_pairs
from heronry.operators.ridge import ridge_logistic
from heronry.operators.windows import epoch
from heronry.plans import series
from heronry.plans.registry import ORACLE_SQL, query
from heronry.plans.spatial import KM, LAT, LON, sites

HOUR, STRAY_SHARE = 3600, 0.25

_FOLD = "list_reduce(list_prepend({{'e': {0}, 'stop': false}}, list_transform({1}, lambda t: {{'e': t, 'stop': false}})), lambda acc, v: CASE WHEN acc.stop OR ({2}) >= quarter THEN {{'e': acc.e, 'stop': true}} ELSE {{'e': v.e, 'stop': false}} END).e"


@query(f"""WITH low AS ({ORACLE_SQL["low_run_islands"]}),
runs AS (SELECT row_number() OVER () AS run, event_type, first_slot * {HOUR} AS a, (last_slot + 1) * {HOUR} AS b, greatest(1, floor({STRAY_SHARE} * expected))::BIGINT AS strays FROM low),
ev AS (SELECT event_type, {series.EPOCH.format('ts')} AS w FROM events),
points AS (SELECT run, w FROM runs JOIN ev USING (event_type) WHERE w BETWEEN a - {HOUR} AND b + {HOUR} UNION ALL SELECT run, max(w) FROM runs JOIN ev USING (event_type) WHERE w < a - {HOUR} GROUP BY run UNION ALL SELECT run, min(w) FROM runs JOIN ev USING (event_type) WHERE w > b + {HOUR} GROUP BY run),
placed AS (SELECT run, w, strays, row_number() OVER (PARTITION BY run ORDER BY w) AS i FROM points JOIN runs USING (run)),
best AS (SELECT p.run, arg_max({{'x': p.w, 'y': q.w}}, (q.w - p.w, -p.i, -q.i)) AS e FROM placed p JOIN placed q ON q.run = p.run AND q.i > p.i AND q.i <= p.i + p.strays + 1 GROUP BY p.run),
inner_ AS (SELECT run, e.x AS x, e.y AS y, coalesce((SELECT list(w ORDER BY w) FROM points WHERE points.run = best.run AND w > e.x AND w < e.y), []::BIGINT[]) AS inside FROM best),
q AS (SELECT *, list_max(list_transform(range(1, len(inside) + 2), lambda k: list_concat(inside, [y])[k] - list_concat([x], inside)[k])) / 4.0 AS quarter FROM inner_),
l AS (SELECT *, {_FOLD.format('x', 'inside', 'v.e - acc.e')} AS x2 FROM q),
r AS (SELECT *, {_FOLD.format('y', 'list_reverse(list_filter(inside, lambda t: t > x2))', 'acc.e - v.e')} AS y2 FROM l),
told AS (SELECT runs.*, x2, y2, coalesce(least(y2, b) - greatest(x2, a) >= 0.5 * (b - a), false) AS measured FROM runs LEFT JOIN r USING (run))
SELECT event_type, a, b, CASE WHEN measured THEN x2 ELSE a END AS start, CASE WHEN measured THEN y2 ELSE b END AS "end", measured FROM told""")
def gap_edges_with_strays(t) -> DataFrame:
    """Measured edges of the low runs: the widest gap with some stray events in it, trimmed where they stand at an edge."""
    low = series.low_run_islands(t)
    runs = low.select(F.concat_ws("/", "event_type", "first_slot").alias("run"), "event_type", (F.col("first_slot") * HOUR).alias("a"), ((F.col("last_slot") + 1) * HOUR).alias("b"), F.greatest(F.lit(1), F.floor(STRAY_SHARE * F.col("expected"))).alias("strays"))
    events = t.events.select("event_type", epoch("ts").alias("at"))
    return refined_edges(runs, events, "event_type", HOUR).drop("run", "strays")


@query()
def site_circles(t) -> DataFrame:
    """Circles that cover all sites, taken greedily; no SQL twin, held against one choice at a time."""
    return circle_cover(sites(t).withColumnRenamed("s_suppkey", "id"), 1500)


@query()
def busy_day_regression(t) -> DataFrame:
    """Whether a day has more orders of a priority than its last week's mean, from the days before it and the weekday; no SQL twin, held against numpy."""
    day = F.to_date("o_orderdate")
    daily = t.orders.groupBy(F.col("o_orderpriority").alias("kind"), day.alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy("day")  # one row a kind and day
    week = F.avg("n").over(w.rowsBetween(-7, -1))
    lagged = daily.select("kind", (F.col("n") > week).cast("int").alias("busy"), (F.lag("n", 1).over(w) / week - 1).alias("before"), (F.avg("n").over(w.rowsBetween(-3, -1)) / week - 1).alias("three"), (F.dayofweek("day") / 7.0).alias("weekday"), F.row_number().over(w).alias("i")).filter("i > 7")
    fitted = ridge_logistic(lagged, "kind", ["before", "three", "weekday"], "busy", 1.0)
    return fitted.select("kind", *(F.round(F.get("coefficients", F.lit(k)), 6).alias(f"b{k}") for k in range(4)))


#: Candidates lie within this distance and time; a small window of days holds few of them.
NEAR_KM, NEAR_S = 400.0, 2 * 86_400


@query(f"""WITH r AS (SELECT o_orderkey AS id, c_nationkey AS nation, {LAT.format("o_custkey")} AS lat, {LON.format("o_custkey")} AS lon, {series.EPOCH.format('o_orderdate')} AS at_, o_orderpriority AS kind FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT a.id AS a, b.id AS b, {KM.format(a="a.lat", b="a.lon", c="b.lat", d="b.lon")} AS km, a.kind <> b.kind AS other FROM r a JOIN r b ON a.nation = b.nation AND a.id < b.id AND abs(a.at_ - b.at_) <= {NEAR_S}),
n AS (SELECT * FROM p WHERE km <= {NEAR_KM} AND NOT (other AND (a + b) % 5 = 0)), l AS (SELECT a AS id, b AS other, km FROM n UNION ALL SELECT b, a, km FROM n)
SELECT id, count(*)::BIGINT AS n_candidates, arg_min(other, (round(km, 6), other)) AS nearest, round(min(km), 4) AS km FROM l GROUP BY id""")
def nearby_candidates(t) -> DataFrame:
    """For each record, how many others of its nation are near in time and space and not kept apart, and the nearest."""
    k = F.col("o_custkey")
    who = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    r = t.orders.join(who, "o_custkey").select("nation", F.col("o_orderkey").alias("id"), synthetic_lat(k).alias("lat"), synthetic_lon(k).alias("lon"), epoch("o_orderdate").alias("at"), F.col("o_orderpriority").alias("kind"))
    pairs = near_pairs(r, NEAR_KM, NEAR_S, ["nation"], also=["kind"])
    kept = pairs.filter((F.col("kind_a") == F.col("kind_b")) | ((F.col("a") + F.col("b")) % 5 != 0))
    links = kept.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "km"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "km"))))
    return links.groupBy("id").agg(F.count("*").alias("n_candidates"), F.min_by("other", F.struct(F.round("km", 6), "other")).alias("nearest"), F.round(F.min("km"), 4).alias("km"))


@query()
def holding_patterns(t) -> DataFrame:
    """Holding patterns in the tracks of the event types, told by a trained network; no SQL twin, held-out accuracy is tested. Hours stand for seconds."""
    s = epoch("ts")
    day = F.floor(s / 86_400)
    # Every third day a track circles, on other days it sways or turns once.
    heading = F.when(day % 3 == 0, (s % 86_400) * 360.0 / 14_400).when(day % 3 == 1, 90 + 70 * F.sin(s / 9000.0)).otherwise(F.least(F.lit(150.0), (s % 86_400) / 300.0))
    points = t.events.select("event_type", s.alias("at"), F.pmod(heading, F.lit(360.0)).alias("heading"))
    found = holdings(holding_windows(points, "event_type", Network(), unit=120.0), "event_type")
    return found.select("event_type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_windows")


@query()
def merges_in_order(t) -> DataFrame:
    """Orders of a nation and priority merged in order of time, survivors judged again; no SQL twin, held against one pass by hand."""
    who = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    k = F.col("o_orderkey")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 24 * HOUR
    r = t.orders.join(who, "o_custkey").select("nation", F.col("o_orderpriority").alias("kind"), k.alias("id"), at.alias("start"), (k % 3).alias("class"), (F.col("o_orderstatus") == "F").alias("public"), (k % 17 == 0).alias("locked"))
    return merge_in_order(r, ["nation", "kind"])


@query()
def bulletins_resolved(t) -> DataFrame:
    """Bulletins of each nation: parts of longer totals and overlaps don't count; no SQL twin, held against one pass by hand."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("n"), F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("published"))
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.sum("l_quantity").alias("q")).groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("regions"))  # three flags
    k = F.col("o_orderkey")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 24 * HOUR
    b = t.orders.join(lines, "o_orderkey").join(flags, "o_orderkey").select(F.col("o_custkey").alias("who"), k.alias("id"), start.alias("start"), (start + (k % 9 + 1) * 40 * 86_400).alias("end"), "published", "n", (k % 4 == 0).alias("total"), (k % 5 != 0).alias("exact"), F.when(k % 3 == 0, F.col("regions")).alias("regions"))
    return resolve_overlaps(b, "who")
