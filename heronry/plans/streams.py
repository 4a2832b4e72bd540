"""Windows and deduplication over streams; the SQL twins are their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.plans.registry import query
from heronry.streaming.replay import event_stream, replay, split_stream, upsert_replay
from heronry.streaming.state import silent_gaps

_NTZ = "timestamp_ntz"


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def stream_tumbling(t) -> DataFrame:
    counted = event_stream(t.spark, t.folder).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return replay(counted, "complete").select(F.col("window.start").cast(_NTZ).alias("start"), "event_type", "n")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start, event_type, count(*)::BIGINT AS n FROM events, (VALUES (0), (1)) AS s(k) GROUP BY ALL""")
def stream_sliding(t) -> DataFrame:
    counted = event_stream(t.spark, t.folder).groupBy(F.window("ts", "12 hours", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return replay(counted, "complete").select(F.col("window.start").cast(_NTZ).alias("start"), "event_type", "n")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*)::BIGINT AS n FROM b GROUP BY user_id, s""")
def stream_session(t) -> DataFrame:
    counted = event_stream(t.spark, t.folder).groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return replay(counted, "complete").select("user_id", F.col("w.start").cast(_NTZ).alias("start"), F.col("w.end").cast(_NTZ).alias("end"), "n")


@query("""SELECT event_type, count(DISTINCT event_id)::BIGINT AS n FROM events GROUP BY event_type""")
def stream_dedup_late(t) -> DataFrame:
    once = event_stream(t.spark, t.folder).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return replay(once, "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT e.event_type, n.n_regionkey::BIGINT AS region, count(*)::BIGINT AS n FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25 GROUP BY ALL""")
def stream_static_join(t) -> DataFrame:
    static = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("region"))
    joined = event_stream(t.spark, t.folder).withColumn("k", F.col("user_id") % 25).join(static, "k")
    return replay(joined.groupBy("event_type", "region").agg(F.count("*").alias("n")), "complete")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, before AS gap_start, ts AS gap_end FROM e WHERE ts - before > INTERVAL 12 HOUR""")
def stream_gap_detector(t) -> DataFrame:
    """Silences of over 12 hours, signalled by the state of each user when the next event comes."""
    gaps = silent_gaps(event_stream(t.spark, t.folder).select("user_id", "ts"), "user_id", hours=12)
    return replay(gaps, "append").select("user_id", F.col("gap_start").cast(_NTZ).alias("gap_start"), F.col("gap_end").cast(_NTZ).alias("gap_end"))


@query("""WITH l AS (SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, count(*)::BIGINT AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, event_id, value FROM l WHERE value >= 1""")
def stream_retract(t) -> DataFrame:
    """A table kept by key over batches in any order: a newer version replaces what stands, and one below 1 retracts it."""
    stream = split_stream(t.spark, t.folder, 4).select("user_id", "event_type", "event_id", "value")
    return upsert_replay(stream, ["user_id", "event_type"], "event_id").filter("value >= 1")
