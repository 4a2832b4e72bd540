"""Time series: baselines, gaps, sessions, smoothing, streaks, local time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.geo import synthetic_lat, synthetic_lon
from heronry.operators.windows import densify, epoch, ewma, islands, latest_per_key, seasonal_baseline, sessionize
from heronry.plans.registry import query

HOURLY = "(SELECT event_type, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS slot, count(*) AS n FROM events GROUP BY ALL)"
EPOCH = "date_diff('second', TIMESTAMP '1970-01-01', {})"
DAYS = "(SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY))::DATE AS d FROM orders)"
WEEKS = "(SELECT w, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(date_trunc('week', o_orderdate)), max(date_trunc('week', o_orderdate)), INTERVAL 7 DAY))::DATE AS w FROM orders) LEFT JOIN (SELECT date_trunc('week', o_orderdate)::DATE AS w, count(*) AS n FROM orders GROUP BY 1) USING (w))"


def hourly(t) -> DataFrame:
    """Events by type and hour, dense between the first and last hour of the table."""
    slot = F.floor(epoch("ts") / 3600).alias("slot")
    return t.events.groupBy("event_type", slot).agg(F.count("*").alias("n"))


def weekly(t) -> DataFrame:
    """Orders by week, with zeros; one row a week."""
    counts = t.orders.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("w")).agg(F.count("*").alias("n"))
    return densify(counts, [], "w", "n", "7 days")


def daily_totals(t) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


BASELINE_SQL = f"""WITH h AS {HOURLY}, p AS (SELECT h.event_type, h.slot, h.n, median(q.n) AS m, count(q.n) AS k FROM h LEFT JOIN h q ON q.event_type = h.event_type AND h.slot - q.slot IN (168, 336, 504, 672) GROUP BY ALL)"""


@query(BASELINE_SQL + " SELECT event_type, slot, n::BIGINT AS n, k::BIGINT AS n_past, CASE WHEN k >= 2 THEN round(m, 4) END AS baseline FROM p")
def seasonal_baseline_hours(t) -> DataFrame:
    b = seasonal_baseline(hourly(t), ["event_type"], "slot", "n", 168, 4, 2)
    return b.select("event_type", "slot", "n", "n_past", F.round("baseline", 4).alias("baseline"))


@query(BASELINE_SQL + """, f AS (SELECT *, coalesce(CASE WHEN k >= 2 THEN n <= 0.8 * m END, false) AS low, coalesce(CASE WHEN k >= 2 THEN n <= 1.0 * m END, false) AS bridge FROM p),
g AS (SELECT *, low OR (bridge AND coalesce(lag(low) OVER w, false) AND coalesce(lead(low) OVER w, false)) AS inn FROM f WINDOW w AS (PARTITION BY event_type ORDER BY slot)),
i AS (SELECT *, sum(CASE WHEN inn AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(inn) OVER (PARTITION BY event_type ORDER BY slot) AS prev FROM g))
SELECT event_type, min(slot) AS first_slot, max(slot) AS last_slot, count(*)::BIGINT AS n_slots, round(sum(m), 4) AS expected, sum(n)::BIGINT AS seen FROM i WHERE inn GROUP BY event_type, island HAVING sum(m) >= 6 AND sum(n) <= 0.8 * sum(m)""")
def low_run_islands(t) -> DataFrame:
    b = seasonal_baseline(hourly(t), ["event_type"], "slot", "n", 168, 4, 2)
    low = F.coalesce(F.col("n") <= 0.8 * F.col("baseline"), F.lit(False))
    bridge = F.coalesce(F.col("n") <= 1.0 * F.col("baseline"), F.lit(False))
    w = Window.partitionBy("event_type").orderBy("slot")
    near = lambda f: F.coalesce(f("low").over(w), F.lit(False))
    b = b.withColumn("low", low).withColumn("flag", F.col("low") | (bridge & near(F.lag) & near(F.lead)))
    runs = islands(b, ["event_type"], "slot", F.col("flag"))
    g = runs.groupBy("event_type", "island").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("n_slots"), F.sum("baseline").alias("e"), F.sum("n").alias("seen"))
    return g.filter("e >= 6 and seen <= 0.8 * e").select("event_type", "first_slot", "last_slot", "n_slots", F.round("e", 4).alias("expected"), "seen")


@query(f"""WITH g AS (SELECT user_id, {EPOCH.format('ts')} AS a, lead({EPOCH.format('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, arg_max(a, (b - a, -a)) AS gap_start, arg_max(b, (b - a, -a)) AS gap_end FROM g WHERE b IS NOT NULL AND a <= 1705708800 AND b >= 1705276800 GROUP BY user_id""")
def gap_edges(t) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = t.events.select("user_id", epoch("ts").alias("a"), F.lead(epoch("ts")).over(w).alias("b")).filter("b is not null and a <= 1705708800 and b >= 1705276800")
    order = F.struct(F.col("b") - F.col("a"), -F.col("a"))
    return g.groupBy("user_id").agg(F.max_by("a", order).alias("gap_start"), F.max_by("b", order).alias("gap_end"))


@query(f"""WITH s AS (SELECT *, {EPOCH.format('ts')} AS e FROM events), n AS (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200 THEN 1 ELSE 0 END AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS session FROM n)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(e) AS first, max(e) AS last FROM k GROUP BY 1, 2""")
def sessionize_gap(t) -> DataFrame:
    s = sessionize(t.events, "user_id", "ts", 43200, "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min(epoch("ts")).alias("first"), F.max(epoch("ts")).alias("last"))


@query(f"""WITH w AS (SELECT w, n, row_number() OVER (ORDER BY w) AS i FROM {WEEKS})
SELECT CAST(a.w AS VARCHAR) AS week, a.n::BIGINT AS n, round(sum(b.n * pow(0.5, (a.i - b.i) / 4.0)) / sum(pow(0.5, (a.i - b.i) / 4.0)), 6) AS ewma FROM w a JOIN w b ON b.i <= a.i GROUP BY a.w, a.n""")
def ewma_halflife(t) -> DataFrame:
    return ewma(weekly(t), [], "w", "n", 4).select(F.col("w").cast("string").alias("week"), "n", F.round("ewma", 6).alias("ewma"))  # one row a week


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM d),
p AS (SELECT a.d, a.v, count(b.v) AS k, list_sort(list(b.v)) AS s FROM r a LEFT JOIN r b ON b.i BETWEEN a.i - 60 AND a.i - 1 AND b.d >= a.d - 60 GROUP BY ALL)
SELECT CAST(d AS VARCHAR) AS day, v AS total, k::BIGINT AS n_prior, k >= 20 AND v > 0 AND v >= s[least(floor(k * 0.9)::INT + 1, k)] AS high FROM p""")
def rolling_p90_flag(t) -> DataFrame:
    w = Window.orderBy("d").rowsBetween(-60, -1)  # one row a day
    d = daily_totals(t).withColumn("past", F.collect_list(F.struct("d", "total")).over(w))
    d = d.withColumn("past", F.array_sort(F.transform(F.filter("past", lambda x: x["d"] >= F.date_sub("d", 60)), lambda x: x["total"])))
    n = F.size("past")
    at = F.get("past", F.least(F.floor(n * 0.9).cast("int"), n - 1))
    return d.select(F.col("d").cast("string").alias("day"), "total", n.cast("long").alias("n_prior"), ((n >= 20) & (F.col("total") > 0) & F.coalesce(F.col("total") >= at, F.lit(False))).alias("high"))


@query(f"""SELECT CAST(w AS VARCHAR) AS week, s4::BIGINT AS last4, round(m52, 6) AS mean52, CASE WHEN v52 > 1.05 * m52 THEN round(m52 * m52 / (v52 - m52), 6) END AS dispersion, coalesce(s4 > 4 * m52 + 2 * sqrt(4 * greatest(v52, m52)), false) AS streak FROM
(SELECT w, sum(n) OVER (ORDER BY w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s4, avg(n) OVER (ORDER BY w ROWS BETWEEN 55 PRECEDING AND 4 PRECEDING) AS m52, var_samp(n) OVER (ORDER BY w ROWS BETWEEN 55 PRECEDING AND 4 PRECEDING) AS v52, count(n) OVER (ORDER BY w ROWS BETWEEN 55 PRECEDING AND 4 PRECEDING) AS k FROM {WEEKS}) WHERE k = 52""")
def streak_4w_vs_52w(t) -> DataFrame:
    w = Window.orderBy("w")
    base = w.rowsBetween(-55, -4)
    s = weekly(t).select("w", F.sum("n").over(w.rowsBetween(-3, 0)).alias("s4"), F.avg("n").over(base).alias("m"), F.var_samp("n").over(base).alias("v"), F.count("n").over(base).alias("k")).filter("k = 52")
    m, v = F.col("m"), F.col("v")
    streak = F.col("s4") > 4 * m + 2 * F.sqrt(4 * F.greatest(v, m))
    return s.select(F.col("w").cast("string").alias("week"), F.col("s4").alias("last4"), F.round("m", 6).alias("mean52"), F.when(v > 1.05 * m, F.round(m * m / (v - m), 6)).alias("dispersion"), F.coalesce(streak, F.lit(False)).alias("streak"))


@query("""WITH g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM (SELECT DISTINCT event_type FROM events), (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events)),
c AS (SELECT g.event_type, g.d, count(e.event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND CAST(e.ts AS DATE) = g.d GROUP BY ALL)
SELECT event_type, CAST(d AS VARCHAR) AS day, n::BIGINT AS n, lag(n) OVER w AS prior, round(avg(n) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean3, (sum(n) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))::BIGINT AS sum7 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY d)""")
def lag_features(t) -> DataFrame:
    counts = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("d")
    return densify(counts, ["event_type"], "d", "n").select("event_type", F.col("d").cast("string").alias("day"), "n", F.lag("n").over(w).alias("prior"), F.round(F.avg("n").over(w.rowsBetween(-3, -1)), 6).alias("mean3"), F.sum("n").over(w.rowsBetween(-7, -1)).alias("sum7"))


@query("""WITH c AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT a.event_type, a.d, median(b.n) AS m, count(b.n) AS k FROM c a JOIN c b ON a.event_type = b.event_type AND b.d BETWEEN a.d - 21 AND a.d - 1 GROUP BY ALL),
f AS (SELECT p.event_type, p.d, p.m, count(*) FILTER (1 - q.n / p.m >= 0.2) AS bad, count(*) AS after FROM p JOIN c q ON q.event_type = p.event_type AND q.d BETWEEN p.d AND p.d + 6 WHERE p.k >= 3 GROUP BY ALL)
SELECT event_type, CAST(d AS VARCHAR) AS day, round(m, 4) AS reference, bad::BIGINT AS n_low, after::BIGINT AS n_after, bad >= 2 AND m >= 0.5 AS loss FROM f""")
def reference_window_loss(t) -> DataFrame:
    c = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    past = c.select("event_type", F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", 21))).alias("d"), "n")
    base = past.groupBy("event_type", "d").agg(F.median("n").alias("m"), F.count("n").alias("k")).join(c.select("event_type", "d"), ["event_type", "d"]).filter("k >= 3")
    later = c.select("event_type", F.explode(F.sequence(F.date_sub("d", 6), F.col("d"))).alias("d"), F.col("n").alias("q"))
    f = base.join(later, ["event_type", "d"]).groupBy("event_type", "d", "m").agg(F.count_if(1 - F.col("q") / F.col("m") >= 0.2).alias("n_low"), F.count("*").alias("n_after"))
    return f.select("event_type", F.col("d").cast("string").alias("day"), F.round("m", 4).alias("reference"), "n_low", "n_after", ((F.col("n_low") >= 2) & (F.col("m") >= 0.5)).alias("loss"))


@query(f"""WITH e AS (SELECT *, {EPOCH.format('ts')} AS s FROM events) SELECT a.event_id, count(b.event_id)::BIGINT AS n_prior, coalesce(a.value > 4 * max(b.value), false) AS unusual FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.s < a.s AND b.s >= a.s - 604800 GROUP BY a.event_id, a.value""")
def habitual_ratio(t) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("s").rangeBetween(-604800, -1)
    e = t.events.withColumn("s", epoch("ts"))
    return e.select("event_id", F.count("event_id").over(w).alias("n_prior"), F.coalesce(F.col("value") > 4 * F.max("value").over(w), F.lit(False)).alias("unusual"))


@query("""WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT prev, event_type, count(*)::BIGINT AS n FROM s WHERE prev IS NOT NULL AND (prev, event_type) NOT IN (('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'click'), ('signup', 'view')) GROUP BY 1, 2""")
def state_transition_violations(t) -> DataFrame:
    allowed = t.spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "click"), ("signup", "view")], "prev string, event_type string")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t.events.select(F.lag("event_type").over(w).alias("prev"), "event_type").filter("prev is not null")
    return steps.join(F.broadcast(allowed), ["prev", "event_type"], "left_anti").groupBy("prev", "event_type").agg(F.count("*").alias("n"))  # a fixed table of five rows


@query("""SELECT CASE WHEN extract(hour FROM ts) >= 18 OR extract(hour FROM ts) < 6 THEN 'night' ELSE 'day' END AS kind, CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS key, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def jornada_bucket(t) -> DataFrame:
    h = F.hour("ts")
    return t.events.groupBy(F.when((h >= 18) | (h < 6), "night").otherwise("day").alias("kind"), F.to_date(F.col("ts") - F.expr("interval 6 hours")).cast("string").alias("key")).agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT *, {EPOCH.format('ts')} AS s FROM events), p AS (SELECT event_id, user_id, s FROM e WHERE event_type = 'purchase'), q AS (SELECT event_id, user_id, s FROM e WHERE event_type = 'error')
SELECT p.event_id, arg_min(q.event_id, (abs(q.s - p.s), q.event_id)) AS nearest, min(abs(q.s - p.s)) AS seconds FROM p JOIN q USING (user_id) GROUP BY p.event_id""")
def nearest_in_time(t) -> DataFrame:
    e = t.events.select("event_id", "user_id", epoch("ts").alias("s"), "event_type").filter("event_type in ('purchase', 'error')")
    w = Window.partitionBy("user_id").orderBy("s", F.col("event_type"), "event_id")  # two passes of a window, no pairs
    err = F.when(F.col("event_type") == "error", F.struct("s", "event_id"))
    before = F.last(err, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = e.withColumn("b", before)
    first_of = seen.filter("event_type = 'error'").groupBy("user_id", "s").agg(F.min("event_id").alias("first_id"))
    after = F.first(err, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    p = seen.withColumn("a", after).filter("event_type = 'purchase'").select("event_id", "user_id", "s", "a", F.col("b.s").alias("bs"))
    p = p.join(first_of.select("user_id", F.col("s").alias("bs"), F.col("first_id").alias("bid")), ["user_id", "bs"], "left")
    down, up = F.struct((F.col("s") - F.col("bs")).alias("d"), F.col("bid").alias("id")), F.struct((F.col("a.s") - F.col("s")).alias("d"), F.col("a.event_id").alias("id"))
    best = F.least(F.when(F.col("bs").isNotNull(), down), F.when(F.col("a").isNotNull(), up))
    return p.withColumn("best", best).filter("best is not null").select("event_id", F.col("best.id").alias("nearest"), F.col("best.d").alias("seconds"))


@query(f"""SELECT a.event_id, b.event_id AS next_id, round(km, 4) AS km, round(km / (sec / 3600.0), 4) AS kmh, (floor(((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) + 22.5) % 360 / 45))::BIGINT AS sector FROM
(SELECT event_id, lead(event_id) OVER w AS nid, {EPOCH.format('ts')} AS s, lead({EPOCH.format('ts')}) OVER w - {EPOCH.format('ts')} AS sec, (event_id * 37 % 1400) / 10.0 - 70 AS lat1, (event_id * 91 % 3600) / 10.0 - 180 AS lon1, lead((event_id * 37 % 1400) / 10.0 - 70) OVER w AS lat2, lead((event_id * 91 % 3600) / 10.0 - 180) OVER w AS lon2,
2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lead((event_id * 37 % 1400) / 10.0 - 70) OVER w - ((event_id * 37 % 1400) / 10.0 - 70)) / 2), 2) + cos(radians((event_id * 37 % 1400) / 10.0 - 70)) * cos(radians(lead((event_id * 37 % 1400) / 10.0 - 70) OVER w)) * pow(sin(radians(lead((event_id * 91 % 3600) / 10.0 - 180) OVER w - ((event_id * 91 % 3600) / 10.0 - 180)) / 2), 2)))) AS km
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a JOIN events b ON a.nid = b.event_id WHERE sec > 60""")
def required_speed(t) -> DataFrame:
    from heronry.functions.geo import bearing_deg, haversine_km, sector

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id")
    p = t.events.select("user_id", "event_id", "ts", epoch("ts").alias("s"), synthetic_lat(k).alias("lat"), synthetic_lon(k).alias("lon"))
    nxt = {c: F.lead(c).over(w).alias(f"n_{c}") for c in ("event_id", "s", "lat", "lon")}
    q = p.select("*", *nxt.values()).filter("n_s - s > 60")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))
    return q.select("event_id", F.col("n_event_id").alias("next_id"), F.round(km, 4).alias("km"), F.round(km / ((F.col("n_s") - F.col("s")) / 3600.0), 4).alias("kmh"), sector(bearing_deg(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))).alias("sector"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'view')
SELECT user_id, event_type AS value, event_id FROM e WHERE r = 1""")
def last_nonnote_value(t) -> DataFrame:
    return latest_per_key(t.events.filter("event_type <> 'view'"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", F.col("event_type").alias("value"), "event_id")


@query(f"""WITH e AS (SELECT user_id, event_type, {EPOCH.format('ts')} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT a.user_id, a.s - b.s AS apart FROM e a JOIN e b ON a.user_id = b.user_id AND a.r = 1 AND b.r = 2 WHERE a.event_type = 'error' AND b.event_type = 'error' AND a.s - b.s >= 3600""")
def dead_after_two_failures(t) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = t.events.select("user_id", "event_type", epoch("ts").alias("s"), F.lag("event_type").over(w).alias("p"), F.lag(epoch("ts")).over(w).alias("ps"), F.row_number().over(back).alias("r"))
    return e.filter("r = 1 and event_type = 'error' and p = 'error' and s - ps >= 3600").select("user_id", (F.col("s") - F.col("ps")).alias("apart"))


@query("""WITH m AS (SELECT max(ts) AS top FROM events), e AS (SELECT event_id, ts, top, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS rd, row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts, event_id) AS rw FROM events, m)
SELECT event_id, CASE WHEN ts >= top - INTERVAL 48 HOUR THEN 'recent' WHEN rd = 1 AND ts >= top - INTERVAL 20 DAY THEN 'daily' ELSE 'weekly' END AS tier FROM e WHERE ts >= top - INTERVAL 48 HOUR OR (rd = 1 AND ts >= top - INTERVAL 20 DAY) OR rw = 1""")
def retention_tiers(t) -> DataFrame:
    top = t.events.agg(F.max("ts").alias("top"))
    first = lambda c: t.events.groupBy(c.alias("b")).agg(F.min(F.struct("ts", "event_id")).alias("f")).select(F.col("f.event_id").alias("event_id"))
    daily, weekly_ = first(F.to_date("ts")).withColumn("rd", F.lit(True)), first(F.date_trunc("week", "ts")).withColumn("rw", F.lit(True))
    e = t.events.select("event_id", "ts").crossJoin(F.broadcast(top)).join(daily, "event_id", "left").join(weekly_, "event_id", "left")  # top: one row
    recent = F.col("ts") >= F.col("top") - F.expr("interval 48 hours")
    day = F.col("rd").isNotNull() & (F.col("ts") >= F.col("top") - F.expr("interval 20 days"))
    return e.filter(recent | day | F.col("rw").isNotNull()).select("event_id", F.when(recent, "recent").when(day, "daily").otherwise("weekly").alias("tier"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS best FROM orders) SELECT CAST(d AS VARCHAR) AS day, best FROM d""")
def best_per_night(t) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query(f"""WITH l AS (SELECT event_type, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS slot, count(*) AS n FROM (SELECT event_type, timezone('Europe/Kyiv', timezone('UTC', ts)) AS ts FROM events) GROUP BY ALL)
SELECT a.event_type, a.slot, a.n::BIGINT AS n, round(coalesce(median(b.n), any_value(d.m)), 4) AS baseline FROM l a LEFT JOIN l b ON a.event_type = b.event_type AND a.slot - b.slot IN (168, 336) LEFT JOIN (SELECT event_type, median(n) AS m FROM l GROUP BY 1) d ON a.event_type = d.event_type GROUP BY a.event_type, a.slot, a.n""")
def local_time_baseline(t) -> DataFrame:
    local = t.events.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.lit("Europe/Kyiv"), F.col("ts")))
    h = local.groupBy("event_type", F.floor(epoch("ts") / 3600).alias("slot")).agg(F.count("*").alias("n"))
    b = seasonal_baseline(h, ["event_type"], "slot", "n", 168, 2, 1)
    fallback = h.groupBy("event_type").agg(F.median("n").alias("m"))
    return b.join(fallback, "event_type").select("event_type", "slot", "n", F.round(F.coalesce("baseline", "m"), 4).alias("baseline"))


@query(f"""WITH e AS (SELECT event_type, event_id, {EPOCH.format('ts')} AS s, user_id FROM events), t AS (SELECT max(s) AS top FROM e)
SELECT event_type, (any_value(top) - max(s))::BIGINT AS age, any_value(top) - max(s) > 600 AS stale, count(DISTINCT s // 86400)::BIGINT AS n_days, round(count(*) / count(DISTINCT s // 86400), 4) AS per_day FROM e, t GROUP BY event_type""")
def freshness_report(t) -> DataFrame:
    top = t.events.agg(F.max(epoch("ts")).alias("top"))
    g = t.events.groupBy("event_type").agg(F.max(epoch("ts")).alias("last"), F.count_distinct(F.to_date("ts")).alias("n_days"), F.count("*").alias("n"))
    age = F.col("top") - F.col("last")
    return g.crossJoin(F.broadcast(top)).select("event_type", age.alias("age"), (age > 600).alias("stale"), "n_days", F.round(F.col("n") / F.col("n_days"), 4).alias("per_day"))


@query("""SELECT event_type, round(avg(value * sin(radians(user_id % 360))), 4) AS u, round(avg(value * cos(radians(user_id % 360))), 4) AS v, round(sqrt(pow(avg(value * sin(radians(user_id % 360))), 2) + pow(avg(value * cos(radians(user_id % 360))), 2)), 4) AS speed FROM events GROUP BY 1""")
def wind_vector_mean(t) -> DataFrame:
    a = F.radians(F.col("user_id") % 360)
    u, v = F.avg(F.col("value") * F.sin(a)), F.avg(F.col("value") * F.cos(a))
    return t.events.groupBy("event_type").agg(F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), F.round(F.sqrt(F.pow(u, 2) + F.pow(v, 2)), 4).alias("speed"))


@query(f"""WITH e AS (SELECT event_id, ts, {EPOCH.format('ts')} AS s, (event_id * 37 % 1400) / 10.0 - 70 AS lat, (event_id * 91 % 3600) / 10.0 - 180 AS lon FROM events),
d AS (SELECT event_id, lat, radians(23.44) * sin(2 * pi() * (s / 86400.0 - 81) / 365.25) AS decl, radians(((s % 86400) / 240.0 - 180) + lon) AS ha FROM e)
SELECT event_id, round(degrees(asin(sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(ha))), 4) AS elevation FROM d""")
def solar_elevation(t) -> DataFrame:
    s, k = epoch("ts"), F.col("event_id")
    lat = F.radians(synthetic_lat(k))
    decl = F.radians(F.lit(23.44)) * F.sin(2 * F.pi() * (s / 86400.0 - 81) / 365.25)
    ha = F.radians(((s % 86400) / 240.0 - 180) + synthetic_lon(k))
    return t.events.select("event_id", F.round(F.degrees(F.asin(F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(ha))), 4).alias("elevation"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY 1) SELECT CAST(d AS VARCHAR) AS day, round(sum(v) OVER (PARTITION BY date_trunc('month', d) ORDER BY d), 2) AS to_date, round((300000 - sum(v) OVER (PARTITION BY date_trunc('month', d) ORDER BY d)) / greatest(1, date_diff('day', d, last_day(d))), 4) AS per_day FROM d""")
def budget_pacing(t) -> DataFrame:
    d = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))
    spent = F.sum("v").over(Window.partitionBy(F.trunc("d", "month")).orderBy("d"))
    return d.select(F.col("d").cast("string").alias("day"), F.round(spent, 2).alias("to_date"), F.round((300000 - spent) / F.greatest(F.lit(1), F.date_diff(F.last_day("d"), "d")), 4).alias("per_day"))
