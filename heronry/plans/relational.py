"""Scans, filters, joins, aggregations and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.operators.windows import latest_per_key, nearest_rank, top_k_per_group, values_at_ranks
from heronry.plans.registry import query

MONEY = "decimal(18,2)"


@query("""SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (value > 50)::BIGINT AS n_high, count(DISTINCT user_id)::BIGINT AS n_users
FROM events WHERE event_type IN ('purchase', 'click', 'error') AND value BETWEEN 1 AND 500 GROUP BY event_type""")
def facet_filter_counts(t) -> DataFrame:
    kept = t.events.filter(F.col("event_type").isin("purchase", "click", "error") & F.col("value").between(1, 500))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 7")
def period_last_n_days(t) -> DataFrame:
    last = t.events.agg(F.max(F.to_date("ts")).alias("last"))
    return t.events.join(F.broadcast(last), F.to_date("ts") > F.date_sub("last", 7)).select("event_id", "event_type")


@query("""WITH b AS (SELECT max(CAST(ts AS DATE)) AS last, min(CAST(ts AS DATE)) AS first FROM events),
c AS (SELECT event_type, count(*) FILTER (CAST(ts AS DATE) > last - 7) AS cur, count(*) FILTER (CAST(ts AS DATE) <= last - 7 AND CAST(ts AS DATE) > last - 14) AS prev, any_value(last - 13 >= first) AS has_prev FROM events, b GROUP BY event_type)
SELECT event_type, cur::BIGINT AS n_current, prev::BIGINT AS n_previous,
CASE WHEN NOT has_prev THEN NULL WHEN abs(cur - prev) <= 1 OR abs(cur - prev) <= 0.1 * prev THEN 'stable' WHEN cur > prev THEN 'up' ELSE 'down' END AS trend,
least(4, floor(cur * 5.0 / max(cur) OVER ()))::BIGINT AS step FROM c""")
def pressure_by_type(t) -> DataFrame:
    day = F.to_date("ts")
    bounds = t.events.agg(F.max(day).alias("last"), F.min(day).alias("first"))
    e = t.events.crossJoin(F.broadcast(bounds))  # one row
    counts = e.groupBy("event_type").agg(
        F.count_if(day > F.date_sub("last", 7)).alias("n_current"),
        F.count_if((day <= F.date_sub("last", 7)) & (day > F.date_sub("last", 14))).alias("n_previous"),
        F.first(F.date_sub("last", 13) >= F.col("first")).alias("has_prev"),
    )
    gap = F.abs(F.col("n_current") - F.col("n_previous"))
    trend = F.when(~F.col("has_prev"), None).when((gap <= 1) | (gap <= 0.1 * F.col("n_previous")), "stable").when(F.col("n_current") > F.col("n_previous"), "up").otherwise("down")
    most = counts.agg(F.max("n_current").alias("most"))
    step = F.least(F.lit(4), F.floor(F.col("n_current") * 5.0 / F.col("most")))
    return counts.crossJoin(F.broadcast(most)).select("event_type", "n_current", "n_previous", trend.alias("trend"), step.cast("long").alias("step"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS n_f, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS n_o,
count(*) FILTER (o_orderstatus = 'P')::BIGINT AS n_p FROM orders GROUP BY 1""")
def pivot_zero_filled(t) -> DataFrame:
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return p.select("o_orderpriority", F.col("F").alias("n_f"), F.col("O").alias("n_o"), F.col("P").alias("n_p"))


@query("""SELECT c_mktsegment AS segment, n_name AS nation, strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((1, 2, 3), (1), (2), (3), ())""")
def grouping_sets_facts(t) -> DataFrame:
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = facts.select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    sets = [[F.col(c) for c in s] for s in (["segment", "nation", "month"], ["segment"], ["nation"], ["month"], [])]
    return facts.groupingSets(sets, "segment", "nation", "month").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT p_brand, count(l_orderkey)::BIGINT AS n_lines, round(coalesce(sum(l_extendedprice), 0), 2) AS cost
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY p_brand""")
def left_join_cost_by_model(t) -> DataFrame:
    lines = t.lineitem.filter("l_quantity > 45")
    return t.part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand").agg(F.count("l_orderkey").alias("n_lines"), F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("cost"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_in_subquery(t) -> DataFrame:
    rich = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(rich, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_not_in(t) -> DataFrame:
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35)) > 0")
def exists_array_element(t) -> DataFrame:
    return t.embeddings.filter(F.exists("embedding", lambda x: x > 0.35)).select("vec_id", "label")


@query("""WITH f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id)
SELECT first_type, count(*)::BIGINT AS n_users FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def first_touch_topk(t) -> DataFrame:
    first = t.events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    return first.groupBy("first_type").agg(F.count("*").alias("n_users")).orderBy(F.desc("n_users"), "first_type").limit(3)


@query("SELECT user_id, event_type, event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key_events(t) -> DataFrame:
    return latest_per_key(t.events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity) AS rank
FROM lineitem QUALIFY rank <= 3""")
def topk_per_group(t) -> DataFrame:
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity"]
    return top_k_per_group(t.lineitem, ["l_suppkey"], 3, *order).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH u AS (SELECT user_id, date_trunc('hour', ts) AS h, event_type, max(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS bad FROM events GROUP BY ALL),
c AS (SELECT h, event_type, count(*) AS n, sum(bad) AS d FROM u GROUP BY ALL)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, n::BIGINT AS n_users, d::BIGINT AS n_bad, round(greatest(0, d - 1) / n, 6) AS share,
CASE WHEN n < 2 THEN NULL WHEN greatest(0, d - 1) / n > 0.1 THEN 'high' WHEN greatest(0, d - 1) / n >= 0.02 THEN 'medium' ELSE 'low' END AS level FROM c""")
def distinct_two_level(t) -> DataFrame:
    per_user = t.events.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type", "user_id").agg(F.bool_or(F.col("value") > 90).alias("bad"))
    c = per_user.groupBy("h", "event_type").agg(F.count("*").alias("n_users"), F.count_if("bad").alias("n_bad"))
    share = F.greatest(F.lit(0), F.col("n_bad") - 1) / F.col("n_users")
    level = F.when(F.col("n_users") < 2, None).when(share > 0.1, "high").when(share >= 0.02, "medium").otherwise("low")
    return c.select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "event_type", "n_users", "n_bad", F.round(share, 6).alias("share"), level.alias("level"))


@query("""WITH h AS (SELECT CAST(ts AS DATE) AS d, date_trunc('hour', ts) AS h, avg(value) AS p, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(d AS VARCHAR) AS day, sum(n)::BIGINT AS n, round(sum(p * n) / sum(n), 6) AS weighted FROM h GROUP BY 1""")
def weighted_rollup(t) -> DataFrame:
    h = t.events.groupBy(F.to_date("ts").alias("d"), F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("p"), F.count("*").alias("n"))
    return h.groupBy(F.col("d").cast("string").alias("day")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query("""SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75
FROM lineitem GROUP BY 1""")
def exact_median_quartiles(t) -> DataFrame:
    quarters = {"p25": 0.25, "med": 0.5, "p75": 0.75}
    spot = lambda q: (F.col("n") - 1) * q + 1
    ranks = {f"{name}_{side}": cut(spot(q)) for name, q in quarters.items() for side, cut in (("low", F.floor), ("high", F.ceil))}
    found = values_at_ranks(t.lineitem, ["l_returnflag"], "l_extendedprice", ranks)
    n = t.lineitem.groupBy("l_returnflag").agg(F.count("l_extendedprice").alias("n"))
    part = lambda q: spot(q) - F.floor(spot(q))
    value = lambda name, q: F.round(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * part(q), 4).alias(name)
    return found.join(n, "l_returnflag").select("l_returnflag", *(value(*x) for x in quarters.items()))


@query("""SELECT o_orderpriority, round(list_sort(list(o_totalprice))[least(floor(count(*) * 0.9)::INT + 1, count(*))], 4) AS p90 FROM orders GROUP BY 1""")
def nearest_rank_p90(t) -> DataFrame:
    rank = F.least(F.floor(F.col("n") * 0.9) + 1, F.col("n"))
    return values_at_ranks(t.orders, ["o_orderpriority"], "o_totalprice", {"p90": rank}).select("o_orderpriority", F.round("p90", 4).alias("p90"))


@query("""WITH c AS (SELECT lang, chr(65 + (hash_key % 6)::INT) AS grade, hash_key % 7 = 0 AS authority, quality = 1 AS backs, source FROM
(SELECT lang, quality, source, CAST(substr(source, 4) AS INT) AS hash_key FROM documents JOIN labels USING (doc_id))),
g AS (SELECT lang, grade, bool_or(authority AND NOT backs) AS denied, bool_or(backs) AS any_back, bool_or(authority AND backs) AS auth,
count(DISTINCT CASE WHEN backs AND grade IN ('A', 'B') THEN source END) AS good, count(*) FILTER (NOT backs) AS against, count(*) FILTER (backs) AS backing FROM c GROUP BY ALL)
SELECT lang, grade, backing::BIGINT AS n_backing, against::BIGINT AS n_against, CASE WHEN denied THEN 5 WHEN NOT any_back THEN 6 WHEN against >= backing THEN 4 WHEN auth OR good >= 2 THEN 1 WHEN good = 1 THEN 2 ELSE 3 END AS class FROM g""")
def credibility_rules(t) -> DataFrame:
    k = F.substring("source", 4, 9).cast("int")
    claims = t.documents.join(t.labels, "doc_id").select("lang", "source", F.char(65 + k % 6).alias("grade"), (k % 7 == 0).alias("authority"), (F.col("quality") == 1).alias("backs"))
    g = claims.groupBy("lang", "grade").agg(
        F.bool_or(F.col("authority") & ~F.col("backs")).alias("denied"),
        F.bool_or(F.col("authority") & F.col("backs")).alias("auth"),
        F.count_distinct(F.when(F.col("backs") & F.col("grade").isin("A", "B"), F.col("source"))).alias("good"),
        F.count_if("backs").alias("n_backing"),
        F.count_if(~F.col("backs")).alias("n_against"),
    )
    rule = F.when(F.col("denied"), 5).when(F.col("n_backing") == 0, 6).when(F.col("n_against") >= F.col("n_backing"), 4).when(F.col("auth") | (F.col("good") >= 2), 1).when(F.col("good") == 1, 2).otherwise(3)
    return g.select("lang", "grade", "n_backing", "n_against", rule.alias("class"))


@query("""SELECT c_nationkey, CASE WHEN count(v) = count(*) THEN round(sum(v), 2) END AS total FROM (SELECT c_nationkey, CASE WHEN c_custkey % 211 <> 0 THEN c_acctbal END AS v FROM customer) GROUP BY 1""")
def null_propagating_sum(t) -> DataFrame:
    v = F.when(F.col("c_custkey") % 211 != 0, F.col("c_acctbal"))
    return t.customer.groupBy("c_nationkey").agg(F.when(F.count(v) == F.count("*"), F.round(F.sum(v), 2)).alias("total"))


@query("""WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)), s AS (SELECT count(*) AS n, count(text) AS a, count(lang) AS b, count(source) AS c, count(quality) AS e, count(toxic) AS f FROM j)
SELECT unnest(['text', 'lang', 'source', 'quality', 'toxic']) AS field, round(unnest([a, b, c, e, f]) / n, 6) AS share FROM s""")
def completeness_report(t) -> DataFrame:
    fields = ["text", "lang", "source", "quality", "toxic"]
    shares = t.documents.join(t.labels, "doc_id", "left").agg(*[F.round(F.count(f) / F.count("*"), 6).alias(f) for f in fields])
    return shares.unpivot([], fields, "field", "share")


@query("""WITH days AS (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY))::DATE AS d FROM events),
seen AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE value > 99.5)
SELECT CAST(date_trunc('week', days.d)::DATE AS VARCHAR) AS week, count(*)::BIGINT AS expected, count(seen.d)::BIGINT AS seen, array_to_string(list_sort(list(CAST(days.d AS VARCHAR)) FILTER (seen.d IS NULL))[1:5], ',') AS missing
FROM days LEFT JOIN seen ON days.d = seen.d GROUP BY 1""")
def coverage_audit(t) -> DataFrame:
    bounds = t.events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("d"))
    seen = t.events.filter("value > 99.5").select(F.to_date("ts").alias("d"), F.lit(True).alias("was")).distinct()
    lost = F.slice(F.array_sort(F.collect_list(F.when(F.col("was").isNull(), F.col("d").cast("string")))), 1, 5)
    g = days.join(seen, "d", "left").groupBy(F.to_date(F.date_trunc("week", "d")).cast("string").alias("week"))
    return g.agg(F.count("*").alias("expected"), F.count("was").alias("seen"), F.when(F.size(lost) > 0, F.array_join(lost, ",")).alias("missing"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders WHERE o_orderkey >= 1000 AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderpriority LIKE '1%' ORDER BY o_orderdate, o_orderkey")
def scan_filter_project(t) -> DataFrame:
    kept = t.orders.filter((F.col("o_orderkey") >= 1000) & (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").startswith("1"))
    return kept.orderBy("o_orderdate", "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("total"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20 AND event_type LIKE 'p%'""")
def json_and_like_predicates(t) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.filter(k.between(10, 20) & F.col("event_type").startswith("p")).select("event_id", k.alias("k"))


@query("""SELECT l_linestatus, l_returnflag, count(*)::BIGINT AS n, sum(CASE WHEN (CASE WHEN l_returnflag = 'R' THEN l_discount < 0.08 ELSE l_discount < 0.05 END) AND l_tax < 0.06 AND l_quantity IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_valid,
min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high FROM lineitem GROUP BY 1, 2""")
def typed_validity_flags(t) -> DataFrame:
    limit = F.when(F.col("l_returnflag") == "R", 0.08).otherwise(0.05)
    valid = F.coalesce((F.col("l_discount") < limit) & (F.col("l_tax") < 0.06) & F.col("l_quantity").isNotNull(), F.lit(False))
    return t.lineitem.groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(';', CASE WHEN l_quantity > 49 THEN 'quantity' END, CASE WHEN l_discount >= 0.1 THEN 'discount' END, CASE WHEN l_tax >= 0.08 THEN 'tax' END) AS errors
FROM lineitem WHERE l_quantity > 49 OR l_discount >= 0.1 OR l_tax >= 0.08""")
def row_error_arrays(t) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") > 49, "discount": F.col("l_discount") >= 0.1, "tax": F.col("l_tax") >= 0.08}
    errors = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return t.lineitem.withColumn("e", errors).filter(F.size("e") > 0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("e", ";").alias("errors"))


@query("""SELECT p_brand, strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_extendedprice), 2) AS spend, round(max(l_extendedprice), 2) AS most FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1, 2""")
def inner_join_spend(t) -> DataFrame:
    j = t.lineitem.join(t.part.filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("spend"), F.round(F.max("l_extendedprice"), 2).alias("most"))


@query("""SELECT event_type, count(DISTINCT user_id)::BIGINT AS n_users, row_number() OVER (ORDER BY min(ts), event_type) AS arrival FROM events GROUP BY event_type""")
def distinct_and_first_seen(t) -> DataFrame:
    g = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("first"))
    return g.withColumn("arrival", F.row_number().over(Window.orderBy("first", "event_type")).cast("long")).drop("first")  # a row a type


@query("""SELECT CAST((o_orderdate - INTERVAL 12 HOUR)::DATE AS VARCHAR) AS night, count(*)::BIGINT AS n, round(sum(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1""")
def night_rollup(t) -> DataFrame:
    night = F.to_date(F.col("o_orderdate") - F.expr("interval 12 hours")).cast("string")
    return t.orders.groupBy(night.alias("night")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice"))), 2).alias("total"))


@query("""WITH j AS (SELECT lang, source, n_chars, quality FROM documents JOIN labels USING (doc_id))
SELECT lang, max(n_chars)::BIGINT AS most, arg_min(source, (CASE quality WHEN 1 THEN 0 ELSE 1 END, -n_chars, source)) AS best_source, CASE WHEN avg(quality) > 0.9 THEN 'A' WHEN avg(quality) > 0.8 THEN 'B' WHEN avg(quality) > 0.5 THEN 'C' ELSE 'D' END AS grade FROM j GROUP BY 1""")
def max_over_sources(t) -> DataFrame:
    j = t.documents.join(t.labels, "doc_id")
    rank = F.struct(F.when(F.col("quality") == 1, 0).otherwise(1), -F.col("n_chars"), F.col("source"))
    q = F.avg("quality")
    return j.groupBy("lang").agg(F.max("n_chars").alias("most"), F.min_by("source", rank).alias("best_source"), F.when(q > 0.9, "A").when(q > 0.8, "B").when(q > 0.5, "C").otherwise("D").alias("grade"))


@query("""SELECT user_id, array_to_string(list_distinct_ordered, ',') AS kinds FROM (SELECT user_id, list(event_type ORDER BY first) AS list_distinct_ordered FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) GROUP BY user_id)""")
def array_distinct_first(t) -> DataFrame:
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    kinds = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(kinds, lambda x: x["event_type"]), ",").alias("kinds"))


@query("""SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'intersect', count(*)::BIGINT FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'except', count(*)::BIGINT FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def union_distinct_ids(t) -> DataFrame:
    a, b = t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"))
    n = lambda op, df: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", a.union(b).distinct()).union(n("intersect", a.intersect(b))).union(n("except", a.subtract(b)))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, to_json(list({'k': o_orderstatus, 'n': n} ORDER BY o_orderstatus)) AS entries FROM (SELECT date_trunc('month', o_orderdate) AS o_orderdate, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def histogram_entries(t) -> DataFrame:
    c = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))
    return c.groupBy("month").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("o_orderstatus").alias("k"), "n")))).alias("entries"))


@query("SELECT doc_id FROM (SELECT doc_id, sha256(doc_id::VARCHAR || ':20240101') AS h FROM documents) ORDER BY h LIMIT 50")
def hash_sample(t) -> DataFrame:
    return t.documents.select("doc_id").orderBy(F.sha2(F.concat_ws(":", "doc_id", F.lit("20240101")), 256)).limit(50)


@query("""SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1)) WHERE r <= 3""")
def distinct_outlet_top3(t) -> DataFrame:
    best = latest_per_key(t.documents.select("lang", "source", "n_chars", "doc_id"), ["lang", "source"], F.desc("n_chars"), "doc_id")
    return top_k_per_group(best, ["lang"], 3, F.desc("n_chars"), "doc_id").select("lang", "doc_id", "source")


@query("""SELECT coalesce(c.c_custkey, o.k) AS k, CASE WHEN c.c_custkey IS NULL THEN 'only_orders' WHEN o.k IS NULL THEN 'only_register' ELSE 'both' END AS status FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 150000) o ON c.c_custkey = o.k""")
def bidirectional_match(t) -> DataFrame:
    a = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("a"))
    b = t.orders.filter("o_totalprice > 150000").select(F.col("o_custkey").alias("k"), F.lit(1).alias("b")).distinct()
    return a.join(b, "k", "full").select("k", F.when(F.col("a").isNull(), "only_orders").when(F.col("b").isNull(), "only_register").otherwise("both").alias("status"))


@query("""SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_lines, any_value(c_mktsegment) AS segment, count(l_orderkey) > 0 AND any_value(c_acctbal) > 0 AS publish FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY 1""")
def overlay_left_joins(t) -> DataFrame:
    base = t.orders.filter("o_totalprice > 300000")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    who = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    j = base.join(lines, "o_orderkey", "left").join(who, "o_custkey", "left").withColumn("n_lines", F.coalesce("n", F.lit(0)))
    return j.groupBy("o_orderkey").agg(F.sum("n_lines").alias("n_lines"), F.first("c_mktsegment").alias("segment"), ((F.sum("n_lines") > 0) & (F.first("c_acctbal") > 0)).alias("publish"))


@query("""SELECT event_id, CASE WHEN user_id % 17 = 0 THEN 'hand' WHEN value > 95 THEN 'strong' WHEN event_type = 'error' THEN 'error' ELSE 'plain' END AS class FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def query_string_filter(t) -> DataFrame:
    from heronry.functions.filters import parse_filter

    kept = t.events.filter(parse_filter("type=purchase,error,bogus&from=2024-01-10&to=2024-01-20&x=1", types=["click", "purchase", "error", "view", "signup"]))
    rule = F.when(F.col("user_id") % 17 == 0, "hand").when(F.col("value") > 95, "strong").when(F.col("event_type") == "error", "error").otherwise("plain")
    return kept.select("event_id", rule.alias("class"))
