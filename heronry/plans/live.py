"""The live detector replayed over the events, beside its twin: the same rules tick by tick in recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.plans.registry import query
from heronry.session import fresh_path
from heronry.sources.slots import slot_stream
from heronry.streaming.closures import DAY, HOUR, STORE, Rules, closure_alerts, usual_of
from heronry.streaming.replay import drain, replay, split_stream

RULES = Rules()
LATE = HOUR
SITES = 10


def _twin(r: Rules) -> str:
    def total(t: str) -> str:
        return f"((({t}) // {DAY} - u.d0) * u.total + u.p[({t}) // {HOUR} % 24 + 1]) * {HOUR} + u.c[({t}) // {HOUR} % 24 + 1] * (({t}) % {HOUR})"

    def expected(a: str, b: str) -> str:
        return f"((({total(b)}) - ({total(a)}))::DOUBLE / (u.days * {float(HOUR)}::DOUBLE))"

    near = "st.start IS NOT NULL"
    resumed = f"{near} AND pt.back >= {r.resume_count} AND pt.back >= {r.resume_share}::DOUBLE * pt.usual"
    return f"""WITH RECURSIVE
m AS MATERIALIZED (SELECT user_id % {SITES} AS site, epoch_us(ts) // 1000 AS t, event_type = 'error' AS report FROM events),
v AS MATERIALIZED (SELECT site, t FROM m WHERE NOT report),
edge AS (SELECT min(t) // {DAY} AS d0, max(t) // {DAY} - min(t) // {DAY} + 1 AS days, min(t) // {r.settle} AS a, max(t) // {r.settle} AS b, count(*) AS n FROM v),
last AS (SELECT max(t) - {LATE} AS upto FROM m),
hours AS (SELECT s.site, h, (SELECT count(*) FROM v WHERE v.site = s.site AND v.t // {HOUR} % 24 = h) AS n FROM (SELECT DISTINCT site FROM v) AS s, range(24) AS x(h)),
u AS MATERIALIZED (SELECT site, c, list_transform(range(24), lambda h: coalesce(list_sum(c[1:h]), 0)) AS p, list_sum(c) AS total, d0, days FROM (SELECT site, list(n ORDER BY h) AS c FROM hours GROUP BY site), edge),
quiet AS (SELECT (h + 1) * {r.settle} AS tick FROM (SELECT unnest(range(a + 1, b + 2)) AS h FROM edge), edge
  WHERE ((h + 1) * {r.settle}) % {r.step} = 0 AND edge.n * {r.source_window} / ((b * {r.settle} // {DAY} - a * {r.settle} // {DAY} + 1) * {DAY}) >= {r.source_least}
  AND (SELECT count(*) FROM v WHERE v.t >= h * {r.settle} - {r.source_window} AND v.t < h * {r.settle}) < {r.source_share} * (edge.n * {r.source_window} / ((b * {r.settle} // {DAY} - a * {r.settle} // {DAY} + 1) * {DAY}))),
ticks AS MATERIALIZED (SELECT site, unnest(range(first, upto + 1, {r.step})) AS tick FROM (SELECT site, (min(t) // {r.step} + 1) * {r.step} AS first FROM m GROUP BY site), last),
known AS MATERIALIZED (SELECT v.site, v.t, row_number() OVER w AS i, (row_number() OVER w - 1) - (count(*) OVER (PARTITION BY v.site ORDER BY v.t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY v.site ORDER BY v.t RANGE BETWEEN {r.before} PRECEDING AND CURRENT ROW)) AS seen, {expected(f"v.t - {r.before}", "v.t")} AS before
  FROM v JOIN u USING (site) WINDOW w AS (PARTITION BY v.site ORDER BY v.t)),
good AS (SELECT site, t, i, least(seen / before, {r.high_factor}::DOUBLE) AS factor FROM known WHERE before >= {r.least_before}::DOUBLE AND seen / before >= {r.low_factor}::DOUBLE),
counted AS MATERIALIZED (SELECT k.site, k.tick, k.tick - {r.settle} AS horizon, (SELECT count(*) FROM v WHERE v.site = k.site AND v.t <= k.tick - {r.settle}) AS n,
  (SELECT count(*) FROM v WHERE v.site = k.site AND v.t <= k.tick - {r.settle} AND v.t >= k.tick - {r.settle + r.open_for}) AS recent, (SELECT count(*) FROM v WHERE v.site = k.site AND v.t > k.tick - {r.settle} AND v.t <= k.tick) AS coming FROM ticks AS k),
starts AS (SELECT c.site, c.tick, g.t AS start, c.n - g.i AS k, {expected("g.t", "c.horizon")} * g.factor AS e, c.recent, greatest(1.0, {r.seen_share}::DOUBLE * {expected(f"c.horizon - {r.open_for}", "c.horizon")} * g.factor) AS allowed, c.horizon
  FROM counted AS c JOIN good AS g ON g.site = c.site AND g.t <= c.horizon AND c.horizon - g.t <= {r.longest} JOIN u ON u.site = c.site),
best AS (SELECT site, tick, arg_max({{'start': start, 'k': k, 'e': e}}, (e - k, -k)) AS s FROM starts
  WHERE recent <= allowed AND e >= {r.least_expected} AND k <= {r.seen_share}::DOUBLE * e AND e * {HOUR} >= {r.least_per_hour}::DOUBLE * (horizon - start) AND tick NOT IN (SELECT tick FROM quiet) GROUP BY ALL),
per AS MATERIALIZED (SELECT c.site, c.tick, c.horizon, c.coming, b.s, {expected(f"c.horizon - {r.resume_window}", "c.horizon")} AS usual FROM counted AS c JOIN u USING (site) LEFT JOIN best AS b ON b.site = c.site AND b.tick = c.tick),
state AS (
  SELECT site, min(tick) - {r.step} AS tick, NULL::BIGINT AS since, NULL::BIGINT AS start, NULL::BIGINT AS detected, NULL::DOUBLE AS e, NULL::BIGINT AS k, NULL::BOOLEAN AS confirmed, []::STRUCT(s VARCHAR, start BIGINT, w BIGINT, e DOUBLE, k BIGINT)[] AS told FROM ticks GROUP BY site
  UNION ALL
  SELECT site, tick, CASE WHEN held OR opens THEN NULL ELSE since2 END, CASE WHEN opens THEN s.start WHEN ends THEN NULL ELSE start END, CASE WHEN opens THEN tick WHEN ends THEN NULL ELSE detected END,
    CASE WHEN opens THEN round(s.e, 6) WHEN ends THEN NULL ELSE e END, CASE WHEN opens THEN s.k WHEN ends THEN NULL ELSE k END, CASE WHEN opens THEN false WHEN ends THEN NULL ELSE confirmed OR confirms END,
    list_concat(list_concat(CASE WHEN confirms THEN [{{'s': 'confirmed', 'start': start, 'w': tick, 'e': e, 'k': k}}] ELSE [] END, CASE WHEN resumes THEN [{{'s': 'resumed', 'start': start, 'w': back_at, 'e': e, 'k': k}}] WHEN ends THEN [{{'s': 'expired', 'start': start, 'w': tick, 'e': e, 'k': k}}] ELSE [] END),
      CASE WHEN opens THEN [{{'s': 'possible', 'start': s.start, 'w': tick, 'e': round(s.e, 6), 'k': s.k}}] ELSE [] END)
  FROM (SELECT *, NOT held AND since2 IS NOT NULL AND coming = 0 AND s IS NOT NULL AND tick - since2 >= {r.persistence} AS opens, resumes OR (held AND tick - detected > {r.expire}) AS ends
    FROM (SELECT pt.*, st.since, st.start, st.detected, st.e, st.k, st.confirmed, {near} AS held, coalesce({near} AND NOT st.confirmed AND pt.reports > 0, false) AS confirms, coalesce({resumed}, false) AS resumes,
        CASE WHEN pt.s IS NULL THEN NULL WHEN pt.coming > 0 THEN st.since ELSE coalesce(st.since, pt.tick) END AS since2
      FROM state AS st JOIN (SELECT p.*, x.start AS x_start, (SELECT count(*) FROM v WHERE v.site = p.site AND v.t <= p.horizon AND v.t > greatest(x.start, p.horizon - {r.resume_window})) AS back,
          (SELECT min(v.t) FROM v WHERE v.site = p.site AND v.t <= p.horizon AND v.t > greatest(x.start, p.horizon - {r.resume_window})) AS back_at,
          (SELECT count(*) FROM m WHERE m.report AND m.site = p.site AND m.t <= p.horizon AND m.t >= x.start - {r.report_before}) AS reports
        FROM per AS p JOIN state AS x ON x.site = p.site AND p.tick = x.tick + {r.step}) AS pt ON pt.site = st.site AND pt.tick = st.tick + {r.step}))),
told AS (SELECT site, unnest(told) AS x FROM state),
said AS (SELECT site, x.s AS state, x.start AS start, x.w AS w, x.e AS expected, x.k AS seen FROM told)
SELECT site, state, make_timestamp(start * 1000) AS start, make_timestamp(w * 1000) AS at, expected, seen FROM (
  SELECT * FROM said UNION ALL SELECT site, 'withdrawn', start, ((w + {r.publish}) // {r.step} + 1) * {r.step}, expected, seen FROM said, last WHERE state = 'resumed' AND ((w + {r.publish}) // {r.step} + 1) * {r.step} <= upto)"""


@query(_twin(RULES))
def live_closures(t) -> DataFrame:
    """Alerts of sites that fall silent, from a stream of files with state, timers and an initial state."""
    site, is_report = F.col("user_id") % SITES, F.col("event_type") == "error"
    moves = t.events.filter(~is_report).select(site.alias("site"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    stream = split_stream(t.spark, t.folder, 6, in_order=True).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{LATE} milliseconds")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, STORE)
    try:
        alerts = replay(closure_alerts(stream, site, is_report, usual_of(moves, RULES), RULES), "append")
    finally:
        t.spark.conf.set(key, before)
    at = lambda c: F.timestamp_millis(c).cast("timestamp_ntz").alias(c)
    return alerts.select("site", "state", at("start"), at("at"), "expected", "seen")


#: The feed of one kind of event by three hours; a slot waits 18 hours, and late ones are read up to twenty days back.
SLOT, WAIT, REREAD = 3 * 3600, 18 * 3600, 20 * 24 * 3600


@query(f"""WITH e AS (SELECT epoch_us(ts) // {SLOT}000000 * {SLOT} AS s FROM events WHERE event_type = 'error'),
p2 AS (SELECT s, count(*) AS n FROM e GROUP BY s),
p1 AS (SELECT s, n FROM p2 WHERE s < (SELECT min(s) + 15 * 86400 FROM p2) AND (s // {SLOT} % 7 <> 3 OR s = (SELECT min(s) FROM p2))),
slots AS (SELECT unnest(range(min(s), max(s) + 1, {SLOT})) AS s FROM p2),
c1 AS (SELECT coalesce(min(slots.s) - {SLOT}, (SELECT max(s) FROM p1)) AS c FROM slots WHERE s <= (SELECT max(s) FROM p1) AND s NOT IN (SELECT s FROM p1) AND (SELECT max(s) FROM p1) - s < {WAIT}),
c2 AS (SELECT coalesce(min(slots.s) - {SLOT}, (SELECT max(s) FROM p2)) AS c FROM slots WHERE s NOT IN (SELECT s FROM p2) AND (SELECT max(s) FROM p2) - s < {WAIT}),
told AS (
  SELECT s, CASE WHEN s IN (SELECT s FROM p1) THEN 'read' ELSE 'lost' END AS state FROM slots, c1 WHERE s <= c1.c
  UNION ALL SELECT s, CASE WHEN s IN (SELECT s FROM p2) THEN 'read' ELSE 'lost' END FROM slots, c1, c2 WHERE s > c1.c AND s <= c2.c
  UNION ALL SELECT s, 'late' FROM slots, c1, c2 WHERE s <= c1.c AND s > c1.c - {REREAD} AND s > c2.c - {REREAD} AND s NOT IN (SELECT s FROM p1) AND s IN (SELECT s FROM p2)
  UNION ALL SELECT s, 'waiting' FROM slots, c2 WHERE s > c2.c)
SELECT state, count(*)::BIGINT AS n_slots, coalesce(sum(n) FILTER (state IN ('read', 'late')), 0)::BIGINT AS n_lines, make_timestamp(min(s) * 1000000) AS first_slot, make_timestamp(max(s) * 1000000) AS last_slot FROM told LEFT JOIN p2 USING (s) GROUP BY state""")
def slots_by_cursor(t) -> DataFrame:
    """Slots read, late, lost and waiting of a feed that is read in two runs; every seventh slot of the first half comes only for the second."""
    seconds = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / SLOT) * SLOT
    feed = t.events.filter("event_type = 'error'").select(seconds.alias("s"), F.to_json(F.struct("event_id", "value")).alias("line"))
    first = feed.agg(F.min("s")).first()[0]
    if first is None:
        return t.spark.createDataFrame([], "state string, n_slots long, n_lines long, first_slot timestamp_ntz, last_slot timestamp_ntz")
    early = (F.col("s") < first + 15 * 86400) & ((F.floor(F.col("s") / SLOT) % 7 != 3) | (F.col("s") == first))
    folder, state = fresh_path(t.spark, "feed"), fresh_path(t.spark, "feed-state")
    stamped = feed.withColumn("slot", F.date_format(F.timestamp_seconds("s"), "yyyyMMddHHmmss"))
    for part in (early, ~early):
        stamped.filter(part).select("slot", "line").repartition("slot").write.mode("append").option("header", False).partitionBy("slot").text(folder)
        slots = drain(slot_stream(t.spark, folder, SLOT, WAIT, REREAD), state)
    last = feed.agg(F.max("s").alias("last"))
    done = slots.select("slot", "state", "line").agg(F.max(F.unix_seconds("slot")).alias("done"))
    waiting = done.crossJoin(last).select(F.explode(F.filter(F.sequence(F.lit(first), F.col("last"), F.lit(SLOT)), lambda s: s > F.col("done"))).alias("s"), F.lit("waiting").alias("state"), F.lit(0).alias("line"))  # one row each
    every = slots.select(F.unix_seconds("slot").alias("s"), "state", "line").unionByName(waiting)
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return every.groupBy("state").agg(F.count_if(F.col("line") == 0).alias("n_slots"), F.count_if(F.col("line") > 0).alias("n_lines"), at(F.min("s")).alias("first_slot"), at(F.max("s")).alias("last_slot"))
