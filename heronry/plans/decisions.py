"""Rules in stages, field decisions, retirement, vocabularies, drift and folds whose outcome depends on the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import fold
from heronry.operators.folds import ordered_fold
from heronry.operators.windows import epoch
from heronry.plans.records import _V2, first_version, second_version
from heronry.plans.registry import query
from heronry.plans.texts import _FOLDED, _WORDS

HOUR = 3600


@query("""WITH j AS (SELECT d.doc_id, n_chars, lang, source, quality, toxic, l.doc_id IS NOT NULL AS judged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN judged AND toxic = 1 THEN 'withhold' WHEN judged AND quality = 1 THEN 'accept' WHEN judged THEN 'review' WHEN n_chars < 40 THEN 'review' WHEN lang <> 'en' AND source IN ('src1', 'src3', 'src5', 'src7') THEN 'withhold' ELSE 'accept' END AS decision,
CASE WHEN judged AND toxic = 1 THEN 'label: toxic' WHEN judged AND quality = 1 THEN 'label: good' WHEN judged THEN 'label: weak' WHEN n_chars < 40 THEN 'too short' WHEN lang <> 'en' AND source IN ('src1', 'src3', 'src5', 'src7') THEN 'source not competent' ELSE 'no objection' END AS reason FROM j""")
def priority_rules(t) -> DataFrame:
    """A judgement outranks every rule; among rules the first that holds decides, and its reason goes with it."""
    judged = t.documents.select("doc_id", "n_chars", "lang", "source").join(t.labels.withColumn("judged", F.lit(True)), "doc_id", "left")
    known = F.col("judged").isNotNull()
    rules = (
        (known & (F.col("toxic") == 1), "withhold", "label: toxic"),
        (known & (F.col("quality") == 1), "accept", "label: good"),
        (known, "review", "label: weak"),
        (F.col("n_chars") < 40, "review", "too short"),
        ((F.col("lang") != "en") & F.col("source").isin("src1", "src3", "src5", "src7"), "withhold", "source not competent"),
        (F.lit(True), "accept", "no objection"),
    )
    verdict = F.coalesce(*(F.when(c, F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))) for c, d, r in rules))
    return judged.select("doc_id", verdict.alias("v")).select("doc_id", "v.decision", "v.reason")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, value AS x, json_extract(props, '$.k')::BIGINT AS y FROM events),
d AS (SELECT *, (s - lag(s) OVER o) / 3600.0 AS hours, lag(x) OVER o AS x0, lag(y) OVER o AS y0 FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id)),
f AS (SELECT user_id, sqrt(pow(x - x0 - 0.5 * hours, 2) + pow(y - y0 + 0.25 * hours, 2)) AS off, 20 + 2 * hours AS allowed FROM d WHERE hours IS NOT NULL)
SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (off <= allowed)::BIGINT AS n_plausible, round(max(off - allowed), 4) AS worst FROM f GROUP BY user_id""")
def drift_vector(t) -> DataFrame:
    """Each position against the one before, moved by a drift an hour; the tolerance grows with the hours."""
    o = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t.events.select("user_id", "event_id", epoch("ts").alias("s"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("long").alias("y"))
    d = e.select("user_id", "x", "y", ((F.col("s") - F.lag("s").over(o)) / 3600.0).alias("hours"), F.lag("x").over(o).alias("x0"), F.lag("y").over(o).alias("y0")).filter("hours is not null")
    off = F.sqrt(F.pow(F.col("x") - F.col("x0") - 0.5 * F.col("hours"), F.lit(2)) + F.pow(F.col("y") - F.col("y0") + 0.25 * F.col("hours"), F.lit(2)))
    f = d.select("user_id", off.alias("off"), (20 + 2 * F.col("hours")).alias("allowed"))
    return f.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("off") <= F.col("allowed")).alias("n_plausible"), F.round(F.max(F.col("off") - F.col("allowed")), 4).alias("worst"))


@query(f"""WITH b AS (SELECT k::BIGINT AS k, bal, CASE WHEN k % 17 <> 0 THEN seg END AS seg FROM ({_V2})), a AS (SELECT c_custkey AS k, c_acctbal AS old_bal, c_mktsegment AS old_seg FROM customer), j AS (SELECT * FROM a JOIN b USING (k)),
f AS (SELECT k, 'bal' AS field, old_bal::VARCHAR AS v1, bal::VARCHAR AS v2, CASE WHEN k % 21 = 0 THEN old_bal ELSE bal END::VARCHAR AS v3 FROM j UNION ALL SELECT k, 'seg', old_seg, seg, CASE WHEN k % 34 = 0 THEN old_seg ELSE seg END FROM j)
SELECT field, CASE WHEN v2 IS DISTINCT FROM v1 AND v3 = v1 THEN 'oscillates' WHEN v1 IS NOT NULL AND v3 IS NULL THEN 'lost' WHEN v3 <> v1 THEN 'contradicted' ELSE 'kept' END AS outcome, count(*)::BIGINT AS n, min(k)::BIGINT AS first_key FROM f GROUP BY ALL""")
def field_diff_keep(t) -> DataFrame:
    """Three versions of a record, field by field: lost, contradicted, back to the first value, or kept."""
    k = F.col("k")
    b = second_version(t.customer).withColumn("seg", F.when(k % 17 != 0, F.col("seg")))
    j = first_version(t.customer).join(b, "k")

    def field(name: str, old: str, new: str, back):
        return F.struct(F.lit(name).alias("field"), F.col(old).cast("string").alias("v1"), F.col(new).cast("string").alias("v2"), F.when(back, F.col(old)).otherwise(F.col(new)).cast("string").alias("v3"))

    f = j.select("k", F.inline(F.array(field("bal", "old_bal", "bal", k % 21 == 0), field("seg", "old_seg", "seg", k % 34 == 0))))
    v1, v2, v3 = F.col("v1"), F.col("v2"), F.col("v3")
    outcome = F.when(~v2.eqNullSafe(v1) & (v3 == v1), "oscillates").when(v1.isNotNull() & v3.isNull(), "lost").when(v3 != v1, "contradicted").otherwise("kept")
    return f.groupBy("field", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query(f"""WITH g AS (SELECT sha256({_FOLDED}) AS h, doc_id, right(source, 1) IN ('0', '2', '4', '6', '8') AS one_side FROM documents), s AS (SELECT h, count(*)::BIGINT AS n_docs, min(doc_id)::BIGINT AS first_doc FROM g GROUP BY h HAVING bool_and(one_side))
SELECT s.h, n_docs, first_doc FROM s WHERE NOT EXISTS (SELECT 1 FROM g JOIN labels l ON l.doc_id = g.doc_id WHERE g.h = s.h)""")
def one_sided_retire(t) -> DataFrame:
    """Texts that only sources of one side carry, unless one of their documents was judged before."""
    hashed = t.documents.select(F.sha2(fold(F.col("text")), 256).alias("h"), "doc_id", F.right("source", F.lit(1)).isin("0", "2", "4", "6", "8").alias("one_side"))
    sided = hashed.groupBy("h").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.bool_and("one_side").alias("only")).filter("only").drop("only")
    recent = hashed.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("h").distinct()
    return sided.join(recent, "h", "left_anti")


@query(f"""WITH w AS (SELECT DISTINCT lang, doc_id % 2 AS later, unnest({_WORDS}) AS word FROM documents), n AS (SELECT lang, word FROM w WHERE later = 1 AND NOT EXISTS (SELECT 1 FROM w o WHERE o.later = 0 AND o.lang = w.lang AND o.word = w.word))
SELECT lang, (SELECT count(*) FROM w WHERE w.lang = n.lang AND later = 0)::BIGINT AS n_known, count(*)::BIGINT AS n_added, min(word) AS first_added FROM n GROUP BY lang""")
def insert_ignore_vocab(t) -> DataFrame:
    """The second half's words go into the first half's vocabulary where they are new; one aggregation tells both."""
    words = t.documents.select("lang", (F.col("doc_id") % 2).alias("later"), F.explode(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("word"))
    first = words.groupBy("lang", "word").agg(F.min("later").alias("later"))
    added = F.col("later") == 1
    counted = first.groupBy("lang").agg(F.count_if(~added).alias("n_known"), F.count_if(added).alias("n_added"), F.min(F.when(added, F.col("word"))).alias("first_added"))
    return counted.filter("n_added > 0")


def _cluster_step(state: dict, row: tuple) -> list[tuple]:
    user, s, _, kind, value = row
    over = [c for c in state["open"] if s - c["last"] > 12 * HOUR]
    state["open"] = [c for c in state["open"] if s - c["last"] <= 12 * HOUR]
    near = [c for c in state["open"] if c["kind"] == kind and abs(c["total"] / c["n"] - value) <= 25]
    if near:
        best = min(near, key=lambda c: (abs(c["total"] / c["n"] - value), c["start"]))
        best.update(last=s, n=best["n"] + 1, total=best["total"] + value)
    else:
        state["open"].append({"kind": kind, "start": s, "last": s, "n": 1, "total": value})
    return _cluster_rows(user, over)


def _cluster_rows(user: int, clusters: list[dict]) -> list[tuple]:
    return [(user, c["kind"], c["start"], c["last"], c["n"], round(c["total"] / c["n"], 4)) for c in clusters]


@query()
def online_cluster(t) -> DataFrame:
    """An event joins its user's open cluster of its type with the nearest mean, at most 25 off, or opens one; 12 idle hours close it. No SQL twin."""
    rows = t.events.select("user_id", epoch("ts").alias("s"), "event_id", "event_type", "value").dropna()
    return ordered_fold(rows, "user_id", ["s", "event_id"], "user_id long, event_type string, start_s long, last_s long, n long, mean double", lambda: {"open": []}, _cluster_step, lambda user, state: _cluster_rows(user, state["open"]))


def _again_step(state: dict, row: tuple) -> list[tuple]:
    user, s, _, kind = row
    out = []
    if state and (s - state["last"] > 48 * HOUR or (kind == "purchase" and s - state["start"] >= 18 * HOUR)):
        out = _again_rows(user, state)
        state.clear()
    if not state:
        state.update(start=s, n=0, kind=kind)
    state.update(last=s, n=state["n"] + 1)
    return out


def _again_rows(user: int, state: dict) -> list[tuple]:
    return [(user, state["start"], state["last"], state["n"], state["kind"])]


@query()
def reoccurrence_split(t) -> DataFrame:
    """A purchase 18 hours or more after its cluster's start opens a new cluster, as do 48 idle hours. No SQL twin."""
    rows = t.events.select("user_id", epoch("ts").alias("s"), "event_id", "event_type").dropna()
    return ordered_fold(rows, "user_id", ["s", "event_id"], "user_id long, start_s long, last_s long, n long, opened_by string", dict, _again_step, _again_rows)
