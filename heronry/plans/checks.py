"""Checks that decide: frequent fires, passes, sums of bounds, periods, a reference set, known cases, bounds of classes, escalation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.geo import synthetic_lat, synthetic_lon
from heronry.functions.tails import at_least
from heronry.operators.windows import epoch
from heronry.plans.registry import query

HOUR, DAY = 3600, 86_400
_S = "(epoch_us({}) // 1000000)"

#: A site burns often: so many days, over so many cells of a hundredth of a degree, in the year before the last day (fixed values).
FIRE_DAYS, FIRE_CELLS, BASE_DAYS = 15, 15, 365


@query(f"""WITH l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_discount >= 0.02 AS sure, CAST(floor((l_partkey * 37 % 1400) * 10) AS BIGINT) AS cy, CAST(floor((l_partkey * 91 % 3600) * 10) AS BIGINT) AS cx FROM lineitem),
b AS (SELECT * FROM l WHERE day > (SELECT max(day) FROM l) - {BASE_DAYS})
SELECT l_suppkey, count(DISTINCT day)::BIGINT AS n_days, count(DISTINCT (cy, cx)) FILTER (sure)::BIGINT AS n_cells, count(DISTINCT day) >= {FIRE_DAYS} AND count(DISTINCT (cy, cx)) FILTER (sure) >= {FIRE_CELLS} AS frequent FROM b GROUP BY l_suppkey""")
def frequent_fires(t) -> DataFrame:
    """Sites where fires are usual and scattered; cells count only surer fires. Days and cells are made distinct before they are counted."""
    day = F.to_date("l_shipdate")
    last = t.lineitem.agg(F.max(day).alias("last"))
    cell = lambda c, n, of: F.floor((F.col(c) * n % of) * 10)
    base = t.lineitem.crossJoin(F.broadcast(last)).filter(day > F.date_sub("last", BASE_DAYS))  # one row
    seen = base.groupBy("l_suppkey", day.alias("day"), cell("l_partkey", 37, 1400).alias("cy"), cell("l_partkey", 91, 3600).alias("cx")).agg(F.bool_or(F.col("l_discount") >= 0.02).alias("sure"))
    days = seen.groupBy("l_suppkey", "day").agg(F.lit(1).alias("one")).groupBy("l_suppkey").agg(F.count("*").alias("n_days"))
    cells = seen.filter("sure").groupBy("l_suppkey", "cy", "cx").agg(F.lit(1).alias("one")).groupBy("l_suppkey").agg(F.count("*").alias("n_cells"))
    both = days.join(cells, "l_suppkey", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    return both.select("l_suppkey", "n_days", "n_cells", ((F.col("n_days") >= FIRE_DAYS) & (F.col("n_cells") >= FIRE_CELLS)).alias("frequent"))


#: A fire is extended if one pass of a satellite shows so many hotspots.
EXTENDED, PASS = 4, 6 * HOUR


@query(f"""WITH p AS (SELECT user_id % 25 AS site, event_type AS satellite, {_S.format('ts')} // {PASS} AS pass, count(*) AS n, max(value) AS top FROM events WHERE value >= 1 GROUP BY ALL)
SELECT site, max(n)::BIGINT AS largest, count(*)::BIGINT AS n_passes, arg_max(satellite, (n, top, satellite)) AS satellite, max(n) >= {EXTENDED} AS extended FROM p GROUP BY site""")
def pass_groups(t) -> DataFrame:
    """The largest group of hotspots that one pass of a satellite shows at each site; weak ones don't count."""
    p = t.events.filter("value >= 1").groupBy((F.col("user_id") % 25).alias("site"), F.col("event_type").alias("satellite"), F.floor(epoch("ts") / PASS).alias("pass")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return p.groupBy("site").agg(F.max("n").alias("largest"), F.count("*").alias("n_passes"), F.max_by("satellite", F.struct("n", "top", "satellite")).alias("satellite"), (F.max("n") >= EXTENDED).alias("extended"))


_RANGES = """SELECT l_orderkey AS k, l_returnflag AS model, sum(CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE floor(l_quantity * 0.9) END) AS lo, sum(CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE CASE WHEN l_linenumber % 2 = 0 THEN floor(l_quantity * 0.9) ELSE l_quantity END END) AS hi,
count(*) FILTER (l_linenumber % 5 = 4) AS unknown, sum(l_quantity) AS told FROM lineitem GROUP BY ALL"""


@query(f"""WITH r AS ({_RANGES}), o AS (SELECT k, sum(lo) AS lo, sum(hi) AS hi, sum(unknown) AS unknown, sum(told) - k % 40 AS total_min, sum(told) + k % 3 - k % 40 AS total_max, bool_and(unknown = 0 AND lo = hi) AS exact, coalesce(sum(lo) FILTER (model = 'R'), 0) AS of_model FROM r GROUP BY k)
SELECT k, CASE WHEN unknown > 0 THEN NULL ELSE lo::BIGINT END AS lowest, CASE WHEN unknown > 0 THEN NULL ELSE hi::BIGINT END AS highest,
CASE WHEN unknown > 0 THEN 'unknown' WHEN lo > total_max THEN 'parts exceed the total' WHEN hi < total_min THEN 'parts fall short of the total' ELSE 'fits' END AS verdict, CASE WHEN exact AND lo > 0 THEN round(of_model / lo, 6) END AS ratio FROM o""")
def totals_within_bounds(t) -> DataFrame:
    """A declared total against the sums of its parts' bounds; one unknown part leaves it unknown, and a ratio needs exact parts."""
    q, odd = F.col("l_quantity"), F.col("l_linenumber") % 5 == 4
    low = F.floor(q * 0.9).cast("double")
    r = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("model")).agg(F.sum(F.when(~odd, low)).alias("lo"), F.sum(F.when(~odd, F.when(F.col("l_linenumber") % 2 == 0, low).otherwise(q))).alias("hi"), F.count_if(odd).alias("unknown"), F.sum(q).alias("told"))
    exact = (F.col("unknown") == 0) & (F.col("lo") == F.col("hi"))
    o = r.groupBy("k").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.sum("unknown").alias("unknown"), F.sum("told").alias("told"), F.bool_and(exact).alias("exact"), F.coalesce(F.sum(F.when(F.col("model") == "R", F.col("lo"))), F.lit(0.0)).alias("of_model"))
    least = F.col("told") - F.col("k") % 40
    known = F.col("unknown") == 0
    verdict = F.when(~known, "unknown").when(F.col("lo") > least + F.col("k") % 3, "parts exceed the total").when(F.col("hi") < least, "parts fall short of the total").otherwise("fits")
    return o.select("k", F.when(known, F.col("lo").cast("long")).alias("lowest"), F.when(known, F.col("hi").cast("long")).alias("highest"), verdict.alias("verdict"), F.when(F.coalesce(F.col("exact"), F.lit(False)) & (F.col("lo") > 0), F.round(F.col("of_model") / F.col("lo"), 6)).alias("ratio"))


#: A start this many days before its publication is of another year; longer periods are summaries; a night ends at nine at the latest (fixed values).
OTHER_YEAR, LONGEST, LATE_NIGHT = 300, 60 * DAY, 2 * HOUR


@query(f"""WITH l AS (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate - INTERVAL 1 YEAR ELSE o_orderdate END + (o_custkey % 24) * INTERVAL 1 HOUR AS s0, e + INTERVAL 12 HOUR + (o_orderkey % 20) * INTERVAL 1 HOUR AS pub, e + INTERVAL 12 HOUR AS e0, o_orderkey % 3 = 0 AS by_day, o_orderkey % 4 = 0 AS about, o_orderkey % 2 = 0 AS evening, o_orderkey % 5 = 0 AS night, o_orderkey % 3 + 1 AS back FROM orders JOIN l ON l_orderkey = o_orderkey),
a AS (SELECT *, {_S.format('s0')} AS s, {_S.format('e0')} AS e, {_S.format('pub')} AS p, {_S.format("s0 + (year(pub) - year(s0)) * INTERVAL 1 YEAR")} AS moved FROM p),
b AS (SELECT *, p - s > {OTHER_YEAR * DAY} AND moved <= e AND e - moved <= {LONGEST} AS year_moved FROM a), c AS (SELECT *, CASE WHEN year_moved THEN moved ELSE s END AS s1, p // {DAY} * {DAY} - back * {DAY} AS told FROM b),
d AS (SELECT *, evening AND by_day AND told + {18 * HOUR} < e AS evening_moved FROM c), f AS (SELECT *, CASE WHEN evening_moved THEN told + {18 * HOUR} ELSE s1 END AS s2 FROM d),
g AS (SELECT *, night AND about AND e - (told + {9 * HOUR}) > {LATE_NIGHT} AND told + {9 * HOUR} > s2 AS night_moved FROM f), h AS (SELECT *, CASE WHEN night_moved THEN told + {9 * HOUR} ELSE e END AS e2 FROM g)
SELECT k, s2::BIGINT AS start, e2::BIGINT AS "end", e2 - s2 > {LONGEST} AS summary, concat_ws(',', CASE WHEN year_moved THEN 'year' END, CASE WHEN evening_moved THEN 'evening' END, CASE WHEN night_moved THEN 'night' END) AS reasons FROM h""")
def corrected_periods(t) -> DataFrame:
    """Periods with a wrong year, an evening start or a night's end corrected, why, and whether what is left is a summary of many days."""
    k, hours = F.col("o_orderkey"), lambda n: F.make_interval(hours=n)
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("shipped"))
    ordered = F.col("o_orderdate").cast("timestamp")
    p = t.orders.join(ends, "o_orderkey").select(k.alias("k"), (F.when(k % 11 == 0, ordered - F.make_interval(years=F.lit(1))).otherwise(ordered) + hours((F.col("o_custkey") % 24).cast("int"))).alias("s0"), (F.col("shipped") + hours((12 + k % 20).cast("int"))).alias("pub"), (F.col("shipped") + hours(F.lit(12))).alias("e0"))
    a = p.select("k", epoch("s0").alias("s"), epoch("e0").alias("e"), epoch("pub").alias("p"), F.unix_seconds(F.col("s0") + F.make_interval(years=F.year("pub") - F.year("s0"))).alias("moved"))
    k = F.col("k")
    b = a.withColumn("year_moved", (F.col("p") - F.col("s") > OTHER_YEAR * DAY) & (F.col("moved") <= F.col("e")) & (F.col("e") - F.col("moved") <= LONGEST))
    c = b.withColumns({"s": F.when(F.col("year_moved"), F.col("moved")).otherwise(F.col("s")), "told": F.floor(F.col("p") / DAY) * DAY - (k % 3 + 1) * DAY})
    evening, morning = F.col("told") + 18 * HOUR, F.col("told") + 9 * HOUR
    d = c.withColumn("evening_moved", (k % 2 == 0) & (k % 3 == 0) & (evening < F.col("e"))).withColumn("s", F.when(F.col("evening_moved"), evening).otherwise(F.col("s")))
    g = d.withColumn("night_moved", (k % 5 == 0) & (k % 4 == 0) & (F.col("e") - morning > LATE_NIGHT) & (morning > F.col("s"))).withColumn("e", F.when(F.col("night_moved"), morning).otherwise(F.col("e")))
    why = F.concat_ws(",", *(F.when(F.col(f"{n}_moved"), n) for n in ("year", "evening", "night")))
    return g.select("k", F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s") > LONGEST).alias("summary"), why.alias("reasons"))


_DECIDED = "SELECT doc_id, (n_chars >= 400 AND n_chars < 100000)::VARCHAR AS good, (n_chars % 97 = 0)::VARCHAR AS toxic FROM documents"


@query(f"""WITH d AS ({_DECIDED}), met AS (SELECT l.doc_id, s.source, unnest([{{'field': 'good', 'want': (l.quality = 1)::VARCHAR, 'got': d.good}}, {{'field': 'toxic', 'want': (l.toxic = 1)::VARCHAR, 'got': d.toxic}}]) AS x FROM labels l LEFT JOIN d USING (doc_id) LEFT JOIN documents s USING (doc_id)),
known AS (SELECT source, x.field AS field FROM met WHERE x.want IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (x.want IS DISTINCT FROM x.got) * 2 > count(*))
SELECT x.field AS field, count(*)::BIGINT AS n, count(*) FILTER (x.want = x.got)::BIGINT AS n_same, count(*) FILTER (x.got IS NULL)::BIGINT AS n_missing, count(*) FILTER (x.want <> x.got AND k.source IS NOT NULL)::BIGINT AS n_known, count(*) FILTER (x.want <> x.got AND k.source IS NULL)::BIGINT AS n_new, min(b.doc_id) FILTER (x.want <> x.got AND k.source IS NULL) AS first_new
FROM met b LEFT JOIN known k ON k.source = b.source AND k.field = x.field WHERE x.want IS NOT NULL GROUP BY x.field""")
def reference_set_check(t) -> DataFrame:
    """Decided values of the documents against the labelled reference set, field by field; a source that mostly differs in a field is a known discrepancy."""
    n = F.col("n_chars")
    decided = t.documents.select("doc_id", "source", ((n >= 400) & (n < 100000)).alias("good"), (n % 97 == 0).alias("toxic"))
    joined = t.labels.select("doc_id", (F.col("quality") == 1).alias("want_good"), (F.col("toxic") == 1).alias("want_toxic")).join(decided, "doc_id", "left")
    both = joined.select("doc_id", "source", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"want_{f}").alias("want"), F.col(f).alias("got")) for f in ("good", "toxic"))))).filter("want is not null")
    known = both.groupBy("source", "field").agg(F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("n_bad"), F.count("*").alias("n")).filter("n_bad * 2 > n").select("source", "field", F.lit(True).alias("known"))
    told = both.join(known, ["source", "field"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    differs = F.col("want") != F.col("got")
    new = differs & ~F.col("known")
    return told.groupBy("field").agg(F.count("*").alias("n"), F.count_if(~differs).alias("n_same"), F.count_if(F.col("got").isNull()).alias("n_missing"), F.count_if(differs & F.col("known")).alias("n_known"), F.count_if(new).alias("n_new"), F.min(F.when(new, F.col("doc_id"))).alias("first_new"))


@query("""WITH v AS (SELECT o_orderkey AS k, o_custkey AS who, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, round(o_totalprice) AS price, lag(o_orderstatus) OVER w AS status0, lag(round(o_totalprice)) OVER w AS price0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT *, status0 IS NULL AS new, concat_ws(',', CASE WHEN status0 = 'F' AND status <> 'F' THEN 'reopened' END, CASE WHEN price < 0.2 * price0 THEN 'price fell' END) AS why, status <> status0 OR price <> price0 AS changed FROM v)
SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT who) FILTER (NOT new AND why <> '')::BIGINT AS n_retained, count(DISTINCT who) FILTER (NOT new AND why = '' AND changed)::BIGINT AS n_changed, count(DISTINCT who) FILTER (new)::BIGINT AS n_new FROM g GROUP BY day""")
def retained_by_day(t) -> DataFrame:
    """By day, records kept back in their version before, changed, and new: each new version of a record against the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = t.orders.select(F.col("o_custkey").alias("who"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice").alias("price"), F.lag("o_orderstatus").over(w).alias("status0"), F.lag(F.round("o_totalprice")).over(w).alias("price0"))
    kept = ((F.col("status0") == "F") & (F.col("status") != "F")) | (F.col("price") < 0.2 * F.col("price0"))
    changed = (F.col("status") != F.col("status0")) | (F.col("price") != F.col("price0"))
    kind = F.when(F.col("status0").isNull(), "new").when(kept, "retained").when(changed, "changed")
    once = v.select("day", "who", kind.alias("kind")).filter("kind is not null").distinct()
    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    counted = once.groupBy("day").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("retained", "changed", "new")))
    return days.join(counted, "day", "left").select(F.col("day").cast("string").alias("day"), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("retained", "changed", "new")))


@query("""WITH o AS (SELECT o_orderkey AS id, c_nationkey AS nation, o_orderpriority AS grp, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey),
base AS (SELECT id, nation, grp, day FROM o WHERE status = 'F' AND id % 3 = 0),
v AS (SELECT o.id, nation, grp, min(CAST(l_shipdate AS DATE)) AS day FROM o JOIN lineitem ON l_orderkey = o.id WHERE l_returnflag = 'R' AND l_quantity >= 40 GROUP BY 1, 2, 3),
v2 AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = v.id) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.nation = v.nation AND b.grp = v.grp AND abs(date_diff('day', b.day, v.day)) <= 1)),
w AS (SELECT id, nation, grp, day FROM o WHERE status = 'P'), ya AS (SELECT * FROM base UNION ALL SELECT * FROM v2),
w2 AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM ya WHERE ya.id = w.id) AND NOT EXISTS (SELECT 1 FROM ya WHERE ya.nation = w.nation AND ya.grp = w.grp AND abs(date_diff('day', ya.day, w.day)) <= 1))
SELECT origin, nation::BIGINT AS nation, count(*)::BIGINT AS n, min(id) AS first FROM (SELECT 'base' AS origin, * FROM base UNION ALL SELECT 'validation', * FROM v2 UNION ALL SELECT 'watch', * FROM w2) GROUP BY ALL""")
def known_cases(t) -> DataFrame:
    """Cases with a known answer from three sources in turn; one that a former source has, by id or by nation, group and a day's difference at most, is left out."""
    who = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("nation"))
    o = t.orders.join(who, "o_custkey").select(F.col("o_orderkey").alias("id"), "nation", F.col("o_orderpriority").alias("grp"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))

    def without(cases: DataFrame, have: DataFrame) -> DataFrame:
        near = have.select("nation", "grp", F.explode(F.array(*(F.date_add("day", d) for d in (-1, 0, 1)))).alias("day")).distinct()
        return cases.join(have.select("id"), "id", "left_anti").join(near, ["nation", "grp", "day"], "left_anti").select("id", "nation", "grp", "day")

    base = o.filter((F.col("status") == "F") & (F.col("id") % 3 == 0)).select("id", "nation", "grp", "day")
    returned = t.lineitem.filter("l_returnflag = 'R' and l_quantity >= 40").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.to_date("l_shipdate")).alias("day"))
    second = without(o.select("id", "nation", "grp").join(returned, "id"), base)
    third = without(o.filter("status = 'P'").select("id", "nation", "grp", "day"), base.unionByName(second))
    every = [x.withColumn("origin", F.lit(name)) for x, name in ((base, "base"), (second, "validation"), (third, "watch"))]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("origin", "nation").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), p AS (SELECT k, s, s % 7 <> 0 AS located, round((s * 37 % 1400) / 10.0 - 70, 1) AS lat, round((s * 91 % 3600) / 10.0 - 180, 1) AS lon FROM i)
SELECT o_orderkey AS attack, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS state, count(s)::BIGINT AS n_impacts, count(*) FILTER (located)::BIGINT AS n_located, coalesce(string_agg(s::VARCHAR || '@' || (lat * 10)::BIGINT || '/' || (lon * 10)::BIGINT, ';' ORDER BY s) FILTER (located), '') AS points
FROM orders LEFT JOIN p ON k = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def attacks_with_impacts(t) -> DataFrame:
    """Published attacks with their different impacts, and the points of those that are located (tenths of a degree)."""
    s = F.col("s")
    impacts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s")).distinct()
    tenth = lambda c: F.round(c * 10).cast("long").cast("string")
    point = F.when(s % 7 != 0, F.struct(s.alias("s"), F.concat(s.cast("string"), F.lit("@"), tenth(synthetic_lat(s)), F.lit("/"), tenth(synthetic_lon(s))).alias("p")))
    told = impacts.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(point)).alias("at"))  # an order's lines
    shown = t.orders.filter("o_orderstatus <> 'P'").join(told, "o_orderkey", "left")
    at = F.coalesce(F.transform("at", lambda x: x["p"]), F.array().cast("array<string>"))
    return shown.select(F.col("o_orderkey").alias("attack"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderstatus").alias("state"), F.coalesce("n", F.lit(0)).alias("n_impacts"), F.size(at).cast("long").alias("n_located"), F.array_join(at, ";").alias("points"))


@query("""WITH m AS (SELECT p_brand AS class, p_partkey, CASE WHEN p_partkey % 101 = 7 THEN NULL ELSE p_retailprice END AS speed FROM part),
c AS (SELECT class, count(*) AS n, bool_and(speed IS NOT NULL) AS all_known, max(speed) AS most FROM m GROUP BY class), need AS (SELECT l_orderkey AS k, max(l_extendedprice / l_quantity) AS speed FROM lineitem WHERE l_quantity > 0 GROUP BY 1),
d AS (SELECT class, n, all_known, most, (SELECT count(*) FROM need WHERE need.speed > c.most) AS over FROM c)
SELECT class, n::BIGINT AS n_models, all_known, CASE WHEN all_known THEN most END AS bound, CASE WHEN all_known THEN over::BIGINT ELSE 0 END AS n_discarded FROM d""")
def class_bounds(t) -> DataFrame:
    """Upper bounds of classes: only a class all of whose models have a figure has one, and discards the cases that none of them reaches."""
    speed = F.when(F.col("p_partkey") % 101 != 7, F.col("p_retailprice"))
    c = t.part.select(F.col("p_brand").alias("class"), speed.alias("speed")).groupBy("class").agg(F.count("*").alias("n_models"), F.bool_and(F.col("speed").isNotNull()).alias("all_known"), F.max("speed").alias("most"))
    need = t.lineitem.filter("l_quantity > 0").groupBy("l_orderkey").agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("need"))
    bounds = c.withColumn("bound", F.when(F.col("all_known"), F.col("most"))).drop("most")
    # A case's place among the different bounds, of which there are as many as classes; then counts from each place on.
    marks = bounds.agg(F.array_sort(F.collect_set("bound")).alias("marks"))
    placed = need.crossJoin(F.broadcast(marks)).groupBy(F.size(F.filter("marks", lambda m: m < F.col("need"))).alias("place")).agg(F.count("*").alias("n"))  # one row
    ranked = bounds.crossJoin(F.broadcast(marks)).withColumn("own", F.array_position("marks", F.col("bound"))).drop("marks")
    over = ranked.join(F.broadcast(placed), F.col("place") >= F.col("own")).groupBy("class").agg(F.sum("n").alias("n_discarded"))  # classes by places
    return bounds.join(over, "class", "left").select("class", "n_models", "all_known", "bound", F.coalesce("n_discarded", F.lit(0)).alias("n_discarded"))


@query("""WITH d AS (SELECT documents.*, quality, toxic, (n_chars % 1000) / 1000.0 AS sure FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, concat_ws(',', CASE WHEN sure < 0.2 THEN 'little confidence: length' END, CASE WHEN quality IS NULL THEN 'missing: quality' END, CASE WHEN lang IS NULL OR lang = '' THEN 'missing: language' END, CASE WHEN quality = 1 AND n_chars < 300 THEN 'no quote: quality' END, CASE WHEN quality = 1 AND toxic = 1 THEN 'contradiction: quality and toxic' END, CASE WHEN toxic = 1 THEN 'critical: toxic' END) AS reasons,
(CASE WHEN sure < 0.2 THEN 1 ELSE 0 END + CASE WHEN quality IS NULL THEN 1 ELSE 0 END + CASE WHEN quality = 1 AND n_chars < 300 THEN 1 ELSE 0 END) >= 2 OR coalesce(toxic = 1, false) AS escalate FROM d""")
def escalation_reasons(t) -> DataFrame:
    """Why a record is read again by a better reader: little confidence, missing fields, no quote, a contradiction, or what is critical."""
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    unsure, missing, unquoted = (F.col("n_chars") % 1000) / 1000.0 < 0.2, F.col("quality").isNull(), good & (F.col("n_chars") < 300)
    reasons = [(unsure, "little confidence: length"), (missing, "missing: quality"), (F.col("lang").isNull() | (F.col("lang") == ""), "missing: language"), (unquoted, "no quote: quality"), (good & toxic, "contradiction: quality and toxic"), (toxic, "critical: toxic")]
    several = unsure.cast("int") + missing.cast("int") + unquoted.cast("int") >= 2
    return d.select("doc_id", F.concat_ws(",", *(F.when(c, why) for c, why in reasons)).alias("reasons"), (several | toxic).alias("escalate"))


@query("""SELECT p_type AS class, count(*)::BIGINT AS n, CASE WHEN count(*) = count(lo) THEN min(lo) END AS lowest, CASE WHEN count(*) = count(hi) THEN max(hi) END AS highest, count(*) FILTER (lo IS NULL OR hi IS NULL)::BIGINT AS n_unknown
FROM (SELECT p_type, CASE WHEN p_partkey % 307 <> 5 THEN round(p_retailprice * 0.9, 2) END AS lo, CASE WHEN p_partkey % 401 <> 9 THEN round(p_retailprice * (1 + p_size / 100.0), 2) END AS hi FROM part) GROUP BY p_type""")
def class_envelopes(t) -> DataFrame:
    """The interval that holds all intervals of a class; one unknown bound leaves that bound unknown."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    p = t.part.select(F.col("p_type").alias("class"), F.when(k % 307 != 5, F.round(price * 0.9, 2)).alias("lo"), F.when(k % 401 != 9, F.round(price * (1 + F.col("p_size") / 100.0), 2)).alias("hi"))
    known = lambda c, f: F.when(F.count("*") == F.count(c), f(c))
    return p.groupBy("class").agg(F.count("*").alias("n"), known("lo", F.min).alias("lowest"), known("hi", F.max).alias("highest"), F.count_if(F.col("lo").isNull() | F.col("hi").isNull()).alias("n_unknown"))


#: A streak is a sum of four weeks that the 52 before would give with at most this probability (fixed value).
STREAK = 0.01


@query(f"""WITH w AS (SELECT o_orderpriority AS kind, date_diff('day', DATE '1970-01-05', CAST(o_orderdate AS DATE)) // 7 AS week FROM orders), b AS (SELECT min(week) AS a, max(week) AS b FROM w),
g AS (SELECT kind, week, count(w2) AS n FROM (SELECT DISTINCT kind FROM w) CROSS JOIN (SELECT unnest(range(a, b + 1)) AS week FROM b) LEFT JOIN (SELECT kind, week, 1 AS w2 FROM w) USING (kind, week) GROUP BY ALL),
s AS (SELECT kind, week, sum(n) OVER (PARTITION BY kind ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS k, avg(n) OVER p AS mean, var_samp(n) OVER p AS var, count(*) OVER p AS past FROM g WINDOW p AS (PARTITION BY kind ORDER BY week ROWS BETWEEN 55 PRECEDING AND 4 PRECEDING)),
r AS (SELECT kind, week, k::BIGINT AS k, 4 * mean AS m, CASE WHEN var > 1.05 * mean THEN 4 * mean * mean / (var - mean) END AS r FROM s WHERE past = 52 AND mean > 0),
t AS (SELECT *, 1 - coalesce(list_sum(list_transform(range(0, k), lambda i: CASE WHEN r IS NULL THEN exp(-m + i * ln(m) - lgamma(i + 1)) ELSE exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * ln(r / (r + m)) + i * ln(m / (r + m))) END)), 0) AS tail FROM r)
SELECT kind, week, k, round(m, 6) AS expected, round(greatest(tail, 0), 6) AS tail, round(greatest(tail, 0), 6) <= {STREAK} AND k > m AS streak FROM t""")
def streak_tails(t) -> DataFrame:
    """Each four weeks' orders against the 52 weeks before them, by the upper tail of their dispersion."""
    day = F.to_date("o_orderdate")
    week = F.floor(F.date_diff(day, F.lit("1970-01-05").cast("date")) / 7)
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("kind"), week.alias("week")).agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    grid = counts.select("kind").distinct().crossJoin(F.broadcast(bounds)).select("kind", F.explode(F.sequence("a", "b")).alias("week"))  # kinds by weeks
    dense = grid.join(counts, ["kind", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("kind").orderBy("week")  # a row a week
    past = w.rowsBetween(-55, -4)
    s = dense.select("kind", "week", F.sum("n").over(w.rowsBetween(-3, 0)).alias("k"), F.avg("n").over(past).alias("mean"), F.var_samp("n").over(past).alias("var"), F.count("*").over(past).alias("past")).filter("past = 52 and mean > 0")
    mean, var = F.col("mean"), F.col("var")
    r = s.select("kind", "week", "k", (4 * mean).alias("m"), F.when(var > 1.05 * mean, 4 * mean * mean / (var - mean)).cast("double").alias("r"))
    tail = F.pandas_udf(lambda k, m, r: pd.Series([at_least(int(a), b, None if c != c else c) for a, b, c in zip(k, m, r)]), "double")
    told = r.withColumn("tail", F.round(F.greatest(tail("k", "m", "r"), F.lit(0.0)), 6))
    return told.select("kind", "week", "k", F.round("m", 6).alias("expected"), "tail", ((F.col("tail") <= STREAK) & (F.col("k") > F.col("m"))).alias("streak"))


@query("""WITH c AS (SELECT source, lang, count(*) AS c FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), z AS (SELECT source, sum(c) AS n FROM c GROUP BY source), l AS (SELECT lang, sum(c) AS n FROM c GROUP BY lang), a AS (SELECT sum(c) AS n, count(DISTINCT lang) AS k FROM c)
SELECT c.source, sum(c)::BIGINT AS n, round(sum(c * ln(c.c / (z.n - 1.0 + a.k))) / sum(c), 6) AS own, round(sum(c * ln(l.n / (a.n - 1.0 + a.k))) / sum(c), 6) AS overall, round(avg(ln(1.0 / a.k)), 6) AS uniform, round(sum(c) FILTER (c.c - 1 >= (SELECT max(d.c) FROM c d WHERE d.source = c.source AND d.lang <> c.lang) OR z.n = c.c) / sum(c), 6) AS hit
FROM c JOIN z USING (source) JOIN l USING (lang), a GROUP BY c.source""".replace("(SELECT max(d.c) FROM c d WHERE d.source = c.source AND d.lang <> c.lang)", "c.rival").replace("FROM c JOIN z", "FROM (SELECT c.*, (SELECT max(d.c) FROM c d WHERE d.source = c.source AND d.lang <> c.lang) AS rival FROM c) AS c JOIN z"))
def leave_one_out(t) -> DataFrame:
    """Log scores of each source's classes with the judged document left out of every count, beside the overall and the even reference.

    All documents of a source and class have the same counts without
    themselves, so the scores come from the table of counts.
    """
    c = t.documents.filter("source is not null and lang is not null").groupBy("source", "lang").agg(F.count("*").alias("c"))
    by_class = c.groupBy("lang").agg(F.sum("c").alias("in_class"))
    total = c.agg(F.sum("c").alias("all"), F.count_distinct("lang").alias("k"))
    w = Window.partitionBy("source")  # a row a class
    ranked = c.select("*", F.sum("c").over(w).alias("in_source"), F.element_at(F.array_sort(F.collect_list("c").over(w)), -1).alias("top"), F.sort_array(F.collect_list("c").over(w), False).alias("sizes"))
    rival = F.when(F.col("c") == F.col("top"), F.get("sizes", F.lit(1))).otherwise(F.col("top"))
    joined = ranked.withColumn("rival", rival).join(by_class, "lang").crossJoin(F.broadcast(total))  # one row
    own, overall = F.log(F.col("c") / (F.col("in_source") - 1.0 + F.col("k"))), F.log(F.col("in_class") / (F.col("all") - 1.0 + F.col("k")))
    hit = (F.col("c") - 1 >= F.col("rival")) | (F.col("in_source") == F.col("c"))
    mean = lambda x: F.round(F.sum(F.col("c") * x) / F.sum("c"), 6)
    return joined.groupBy("source").agg(F.sum("c").alias("n"), mean(own).alias("own"), mean(overall).alias("overall"), F.round(F.avg(F.log(1.0 / F.col("k"))), 6).alias("uniform"), F.round(F.sum(F.when(hit, F.col("c"))) / F.sum("c"), 6).alias("hit"))
