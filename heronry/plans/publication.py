"""What leaves the register: projections, redirects, survivors, revisions, gates and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.project import mark_internal, project, public_columns
from heronry.operators.graphs import resolve_chains
from heronry.plans.registry import query

#: How a line was told and what it says, from its keys; one expression for both sides.
_MODE = "CASE (l_suppkey + l_linenumber) % 7 WHEN 0 THEN 'AIR' WHEN 1 THEN 'REG AIR' WHEN 2 THEN 'MAIL' WHEN 3 THEN 'SHIP' WHEN 4 THEN 'TRUCK' WHEN 5 THEN 'RAIL' ELSE 'FOB' END"
_WORD = "CASE l_partkey % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'TAKE BACK RETURN' WHEN 2 THEN 'COLLECT COD' ELSE 'DELIVER IN PERSON' END"
_LINES = f"(SELECT *, {_MODE} AS l_shipmode, {_WORD} AS l_shipinstruct FROM lineitem)"


def lines_of(t) -> DataFrame:
    return t.lineitem.withColumns({"l_shipmode": F.expr(_MODE), "l_shipinstruct": F.expr(_WORD)})


@query("""WITH l AS (SELECT l_orderkey AS k, list({'part': l_partkey, 'n': CAST(l_quantity AS INT)} ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, to_json({'status': o_orderstatus, 'lines': lines})::VARCHAR AS shown FROM orders JOIN l ON k = o_orderkey""")
def path_projection(t) -> DataFrame:
    """Nested records keep the closed list of paths alone, also inside lists; an unknown path is an error."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("n"), F.col("l_suppkey").alias("by"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    nested = t.orders.withColumnRenamed("o_orderkey", "k").join(lines, "k").select("k", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("clerk"), "lines").alias("record"))
    kept = project(nested, ["k", "record.status", "record.lines[].part", "record.lines[].n"])
    return kept.select("k", F.to_json("record").alias("shown"))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def visibility_columns(t) -> DataFrame:
    """The columns that the schema's metadata doesn't hold back."""
    marked = mark_internal(t.part.select("p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice"), "p_type", "p_retailprice")
    return marked.select(*public_columns(marked))


@query(f"""WITH s AS (SELECT l_orderkey AS k, list_filter(list(l_shipmode ORDER BY l_linenumber, l_shipmode, l_linestatus), lambda m: m NOT IN ('AIR', 'REG AIR')) AS sources,
list_filter(list({{'step': l_linestatus, 'cites': l_shipmode}} ORDER BY l_linenumber, l_shipmode, l_linestatus), lambda h: h.cites NOT IN ('AIR', 'REG AIR')) AS history FROM {_LINES} GROUP BY 1)
SELECT k, array_to_string(sources, ',') AS sources, len(history)::BIGINT AS n_steps FROM s WHERE len(sources) > 0""")
def public_sources_only(t) -> DataFrame:
    """Internal sources go, with the steps of the history that cite them; a record without any other goes itself."""
    inner = F.array(F.lit("AIR"), F.lit("REG AIR"))
    row = F.struct("l_linenumber", F.col("l_shipmode").alias("source"), F.struct(F.col("l_linestatus").alias("step"), F.col("l_shipmode").alias("cites")).alias("past"))
    told = lines_of(t).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    kept = told.select("k", F.filter("r.source", lambda s: ~F.array_contains(inner, s)).alias("sources"), F.filter("r.past", lambda h: ~F.array_contains(inner, h["cites"])).alias("history"))
    return kept.filter(F.size("sources") > 0).select("k", F.array_join("sources", ",").alias("sources"), F.size("history").cast("long").alias("n_steps"))


_MERGES = "(SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS up, o_orderstatus AS status FROM orders)"


@query(f"""WITH RECURSIVE m AS (SELECT * FROM {_MERGES}), r AS (SELECT k, up AS root FROM m WHERE up IS NOT NULL UNION ALL SELECT r.k, m.up FROM r JOIN m ON m.k = r.root WHERE m.up IS NOT NULL),
top AS (SELECT r.k, r.root FROM r JOIN m ON m.k = r.root WHERE m.up IS NULL)
SELECT '/record/' || top.k AS address, CASE WHEN m.status = 'P' THEN 410 ELSE 301 END AS code, CASE WHEN m.status = 'P' THEN NULL ELSE '/record/' || root END AS target FROM top JOIN m ON m.k = root""")
def redirect_map(t) -> DataFrame:
    """Addresses of merged records go to the end of their chain, or are gone where that is withdrawn."""
    before = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    merges = t.orders.select(F.col("o_orderkey").alias("k"), F.lag("o_orderkey").over(before).alias("up"), F.col("o_orderstatus").alias("status"))
    roots = resolve_chains(merges.filter("up IS NOT NULL").select("k", "up"))
    live = merges.select(F.col("k").alias("root"), (F.col("status") == "P").alias("gone"))
    address = lambda c: F.concat(F.lit("/record/"), F.col(c))
    return roots.join(live, "root").select(address("k").alias("address"), F.when(F.col("gone"), 410).otherwise(301).alias("code"), F.when(~F.col("gone"), address("root")).alias("target"))


@query(f"""WITH n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_shipmode = 'MAIL') AS direct, min(l_shipdate) AS first FROM {_LINES} GROUP BY 1),
g AS (SELECT o_custkey AS who, o_orderpriority AS kind, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderstatus = 'F') DESC, year(CAST(o_orderdate AS DATE)), direct DESC, n DESC, first, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS size FROM orders JOIN n ON l_orderkey = o_orderkey)
SELECT who, kind, id AS survivor, size::BIGINT AS size FROM g WHERE place = 1 AND size > 1""")
def survivor_choice(t) -> DataFrame:
    """Of duplicates the public one stays, then the earlier year, more direct sources, more sources, the earliest news, the lowest id."""
    told = lines_of(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_shipmode") == "MAIL").alias("direct"), F.min("l_shipdate").alias("first"))
    rank = F.struct(F.col("o_orderstatus") != "F", F.year(F.to_date("o_orderdate")), -F.col("direct"), -F.col("n"), F.col("first"), F.col("o_orderkey").alias("id"))
    best = t.orders.join(told, "o_orderkey").groupBy(F.col("o_custkey").alias("who"), F.col("o_orderpriority").alias("kind")).agg(F.min(rank)["id"].alias("survivor"), F.count("*").alias("size"))
    return best.filter("size > 1")


@query("""WITH p AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem GROUP BY 1), m AS (SELECT a.k, a.parts AS own, b.parts AS taken FROM p a JOIN p b ON b.k = a.k + 1),
c AS (SELECT *, list_filter(list_distinct(list_concat(own, taken)), lambda x: x % 7 <> 0) AS now FROM m)
SELECT k, len(now)::BIGINT AS n_before, array_to_string(list_sort(list_filter(now, lambda x: list_contains(own, x) OR NOT list_contains(taken, x))), ',') AS after FROM c""")
def unmerge(t) -> DataFrame:
    """A merge is taken back: what it copied goes, what the record had before or lost since doesn't change."""
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("own"))
    pairs = parts.join(parts.select((F.col("k") - 1).alias("k"), F.col("own").alias("taken")), "k")
    now = pairs.withColumn("now", F.filter(F.array_union("own", "taken"), lambda x: x % 7 != 0))
    copied = F.array_except("taken", "own")
    return now.select("k", F.size("now").cast("long").alias("n_before"), F.array_join(F.array_sort(F.array_except("now", copied)), ",").alias("after"))


@query("""WITH c AS (SELECT DISTINCT sha256(text || '|v2') AS h FROM documents WHERE doc_id % 3 = 0)
SELECT lang, count(*)::BIGINT AS n, count(c.h)::BIGINT AS n_cached, count(DISTINCT CASE WHEN c.h IS NULL THEN sha256(text || '|v2') END)::BIGINT AS n_calls FROM documents LEFT JOIN c ON c.h = sha256(text || '|v2') GROUP BY lang""")
def content_cache(t) -> DataFrame:
    """Answers are kept by the hash of content and version; equal contents are asked once."""
    key = F.sha2(F.concat("text", F.lit("|v2")), 256).alias("h")
    asked = t.documents.select("lang", key)
    cache = t.documents.filter("doc_id % 3 = 0").select(key, F.lit(True).alias("cached")).distinct()
    per = asked.groupBy("lang", "h").agg(F.count("*").alias("n")).join(cache, "h", "left")
    return per.groupBy("lang").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("cached"), F.col("n"))), F.lit(0)).alias("n_cached"), F.count_if(F.col("cached").isNull()).alias("n_calls"))


@query(f"""WITH s AS (SELECT l_orderkey AS k, l_shipinstruct IN ('NONE', 'TAKE BACK RETURN') AS no_event FROM {_LINES})
SELECT k, count(*)::BIGINT AS n_sources, count(*) FILTER (no_event)::BIGINT AS n_no_event, bool_and(no_event) AS dropped FROM s GROUP BY k""")
def non_event_records(t) -> DataFrame:
    """A record is dropped only if none of its sources tells of an event."""
    marked = lines_of(t).select(F.col("l_orderkey").alias("k"), F.col("l_shipinstruct").isin("NONE", "TAKE BACK RETURN").alias("no_event"))
    return marked.groupBy("k").agg(F.count("*").alias("n_sources"), F.count_if("no_event").alias("n_no_event"), F.bool_and("no_event").alias("dropped"))


_CERTAIN, _HEDGED = "(confirms|confirmed|hits)", "(reportedly|possible|alleged)"
_HEAD = "CASE o_orderkey % 5 WHEN 0 THEN 'Army confirms strike' WHEN 1 THEN 'Drone reportedly seen' WHEN 2 THEN 'Possible drone over port' WHEN 3 THEN 'Drone hits depot' ELSE 'Flights delayed' END || ' near ' || lower(o_orderpriority)"


@query(f"""WITH h AS (SELECT o_orderkey AS id, {_HEAD} AS head, o_orderstatus AS presence FROM orders)
SELECT id, NOT ((presence = 'F' AND regexp_matches(lower(head), '{_HEDGED}')) OR (presence <> 'F' AND regexp_matches(lower(head), '{_CERTAIN}'))) AS coherent,
CASE WHEN presence <> 'F' THEN replace(replace(head, 'Army confirms strike', 'Army on possible strike'), 'Drone hits', 'Drone reportedly hits') ELSE replace(replace(head, 'reportedly ', ''), 'Possible drone', 'Drone') END AS rewritten FROM h""")
def headline_coherence(t) -> DataFrame:
    """The certainty of a headline has to match the state of what it tells; where it doesn't, it is reworded."""
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, "Army confirms strike").when(k == 1, "Drone reportedly seen").when(k == 2, "Possible drone over port").when(k == 3, "Drone hits depot").otherwise("Flights delayed")
    h = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(said, F.lit(" near "), F.lower("o_orderpriority")).alias("head"), (F.col("o_orderstatus") == "F").alias("sure"))
    head, low = F.col("head"), F.lower("head")
    swap = lambda c, *pairs: swap(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else c
    wrong = (F.col("sure") & low.rlike(_HEDGED)) | (~F.col("sure") & low.rlike(_CERTAIN))
    milder = swap(head, ("Army confirms strike", "Army on possible strike"), ("Drone hits", "Drone reportedly hits"))
    return h.select("id", (~wrong).alias("coherent"), F.when(~F.col("sure"), milder).otherwise(swap(head, ("reportedly ", ""), ("Possible drone", "Drone"))).alias("rewritten"))


@query("""WITH c AS (SELECT s_nationkey AS n, round(avg(s_suppkey * 37 % 1400 / 10.0 - 70), 4) AS lat, round(avg(s_suppkey * 91 % 3600 / 10.0 - 180), 4) AS lon FROM supplier GROUP BY 1)
SELECT c_custkey AS id, c_custkey % 3 <> 0 AS approximate, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 37 % 1400 / 10.0 - 70 ELSE lat END AS lat, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 91 % 3600 / 10.0 - 180 ELSE lon END AS lon FROM customer LEFT JOIN c ON n = c_nationkey""")
def approximate_location(t) -> DataFrame:
    """A record without a point gets the middle of its region, and says so."""
    lat, lon = lambda k: F.col(k) * 37 % 1400 / 10.0 - 70, lambda k: F.col(k) * 91 % 3600 / 10.0 - 180
    middle = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.round(F.avg(lat("s_suppkey")), 4).alias("mid_lat"), F.round(F.avg(lon("s_suppkey")), 4).alias("mid_lon"))
    own = F.col("c_custkey") % 3 == 0
    return t.customer.join(middle, "c_nationkey", "left").select(F.col("c_custkey").alias("id"), (~own).alias("approximate"), F.when(own, lat("c_custkey")).otherwise(F.col("mid_lat")).alias("lat"), F.when(own, lon("c_custkey")).otherwise(F.col("mid_lon")).alias("lon"))


_STATE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


@query(f"""WITH s AS (SELECT user_id, event_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*)::BIGINT AS n_steps, count(*) FILTER (before IS NOT NULL AND state > before + 1)::BIGINT AS n_skipped, count(*) FILTER (before IS NOT NULL AND state < before)::BIGINT AS n_back FROM s GROUP BY user_id""")
def history_coherence(t) -> DataFrame:
    """Steps of a day's history that skip a state or go back behind one."""
    state = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(0)
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    steps = t.events.withColumn("state", state).withColumn("before", F.lag("state").over(w))
    return steps.groupBy("user_id").agg(F.count("*").alias("n_steps"), F.count_if(F.col("state") > F.col("before") + 1).alias("n_skipped"), F.count_if(F.col("state") < F.col("before")).alias("n_back"))


@query("""WITH e AS (SELECT user_id AS source, ts, value >= 20 AS good FROM events), l AS (SELECT max(ts) AS now FROM events), g AS (SELECT source, max(ts) FILTER (good) AS last_good FROM e GROUP BY source)
SELECT e.source, count(*)::BIGINT AS n_failed, CAST(date_diff('second', any_value(last_good), any_value(now)) // 3600 AS BIGINT) AS unread_hours, any_value(last_good) IS NULL OR date_diff('second', any_value(last_good), any_value(now)) // 3600 > 24 AS alert
FROM e JOIN g USING (source), l WHERE NOT good AND (last_good IS NULL OR ts > last_good) GROUP BY e.source""")
def failing_sources(t) -> DataFrame:
    """Sources whose latest readings failed: how many in a row, and whether the last good one is over a day old."""
    e = t.events.select(F.col("user_id").alias("source"), "ts", (F.col("value") >= 20).alias("good"))
    last = e.groupBy("source").agg(F.max(F.when(F.col("good"), F.col("ts"))).alias("last_good"), F.max("ts").alias("latest"))
    now = last.agg(F.max("latest").alias("now"))
    streak = e.filter("NOT good").join(last, "source").filter("last_good IS NULL OR ts > last_good").groupBy("source").agg(F.count("*").alias("n_failed"), F.first("last_good").alias("last_good"))
    hours = F.floor(F.timestamp_diff("SECOND", F.col("last_good"), F.col("now")) / 3600)
    return streak.crossJoin(F.broadcast(now)).select("source", "n_failed", hours.cast("long").alias("unread_hours"), F.coalesce(hours > 24, F.lit(True)).alias("alert"))  # one row


@query("""SELECT o_orderstatus AS support, CASE WHEN age <= 2 THEN 'hold' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'publish, headline supports it' WHEN age > 30 THEN 'publish at country level' ELSE 'hold' END AS outcome, count(*)::BIGINT AS n
FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') % 60 AS age FROM orders) GROUP BY ALL""")
def withheld_barrier(t) -> DataFrame:
    """Withheld records wait, pass by the support of a headline, or after a month with their country alone."""
    age = F.date_diff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate")) % 60
    outcome = F.when(age <= 2, "hold").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "publish, headline supports it").when(age > 30, "publish at country level").otherwise("hold")
    return t.orders.groupBy(F.col("o_orderstatus").alias("support"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_nationkey AS family, o_orderpriority AS kind, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT family, kind, n, sum(n) OVER (PARTITION BY family) AS total, row_number() OVER (PARTITION BY family ORDER BY n DESC, kind) AS place, lead(n) OVER (PARTITION BY family ORDER BY n DESC, kind) AS second FROM a)
SELECT family, kind AS lead, CASE WHEN total < 30 THEN 'no base' WHEN n >= 1.1 * coalesce(second, 0) THEN 'publish' ELSE 'undecided' END AS verdict FROM r WHERE place = 1""")
def publishable_inference(t) -> DataFrame:
    """An inferred kind is published if its group has a base and leads the next one clearly."""
    told = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("family")), "o_custkey").groupBy("family", F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("family").orderBy(F.desc("n"), "kind")
    ranked = told.withColumns({"total": F.sum("n").over(Window.partitionBy("family")), "place": F.row_number().over(w), "second": F.coalesce(F.lead("n").over(w), F.lit(0))})
    verdict = F.when(F.col("total") < 30, "no base").when(F.col("n") >= 1.1 * F.col("second"), "publish").otherwise("undecided")
    return ranked.filter("place = 1").select("family", F.col("kind").alias("lead"), verdict.alias("verdict"))


@query(f"""WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_shipmode)) AS zones FROM {_LINES} GROUP BY 1), o AS (SELECT o_orderkey AS id, o_custkey % 40 AS source, CAST(o_orderdate AS DATE) AS night, zones FROM orders JOIN s ON s.id = o_orderkey),
b AS (SELECT source, night, arg_max(id, (len(zones), -id)) AS summary, arg_max(zones, (len(zones), -id)) AS named FROM o GROUP BY ALL)
SELECT o.id, b.summary FROM o JOIN b USING (source, night) WHERE o.id <> b.summary AND list_has_all(b.named, o.zones)""")
def zone_alerts_folded(t) -> DataFrame:
    """Alerts of one source and night whose zones the night's summary names are folded into it."""
    zones = lines_of(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_shipmode")).alias("zones"))
    o = t.orders.join(zones, "o_orderkey").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("source"), F.to_date("o_orderdate").alias("night"), "zones")
    best = o.groupBy("source", "night").agg(F.max_by(F.struct("id", "zones"), F.struct(F.size("zones"), -F.col("id"))).alias("b"))
    return o.join(best, ["source", "night"]).filter((F.col("id") != F.col("b.id")) & (F.size(F.array_except("zones", "b.zones")) == 0)).select("id", F.col("b.id").alias("summary"))


@query(f"""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS place, CASE l_shipinstruct WHEN 'NONE' THEN 'deny' WHEN 'COLLECT COD' THEN 'confirm' WHEN 'DELIVER IN PERSON' THEN 'attribute' ELSE 'other' END AS act FROM {_LINES})
SELECT id, CASE WHEN arg_max(act, (place, act)) FILTER (act IN ('deny', 'confirm')) IS NULL THEN 'reported' WHEN arg_max(act, (place, act)) FILTER (act IN ('deny', 'confirm')) = 'deny' THEN 'denied' WHEN count(*) FILTER (act = 'attribute') > 0 THEN 'attributed' ELSE 'confirmed' END AS state FROM s GROUP BY id""")
def official_effects(t) -> DataFrame:
    """The last official word decides: denied, or confirmed, or attributed where some statement names who it was."""
    act = F.when(F.col("l_shipinstruct") == "NONE", "deny").when(F.col("l_shipinstruct") == "COLLECT COD", "confirm").when(F.col("l_shipinstruct") == "DELIVER IN PERSON", "attribute").otherwise("other")
    told = lines_of(t).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), act.alias("act"))
    word = F.when(F.col("act").isin("deny", "confirm"), F.struct("at", "act"))
    last = told.groupBy("id").agg(F.max(word)["act"].alias("word"), F.count_if(F.col("act") == "attribute").alias("n"))
    return last.select("id", F.when(F.col("word").isNull(), "reported").when(F.col("word") == "deny", "denied").when(F.col("n") > 0, "attributed").otherwise("confirmed").alias("state"))
