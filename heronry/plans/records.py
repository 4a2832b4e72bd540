"""Versions, gates, overrides, invariants, evidence and simple scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.plans.registry import query

_V2 = "SELECT c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 11 <> 0"


def second_version(customer: DataFrame) -> DataFrame:
    """Edits by key: one in seven changed, one in eleven gone, one in thirteen under a new key."""
    key = F.col("c_custkey")
    return customer.filter(key % 11 != 0).select((key + F.when(key % 13 == 0, 1000000).otherwise(0)).alias("k"), F.when(key % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("bal"), F.col("c_mktsegment").alias("seg"))


def first_version(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("old_bal"), F.col("c_mktsegment").alias("old_seg"))


@query(f"""WITH b AS ({_V2}), a AS (SELECT c_custkey AS k, c_acctbal AS old_bal, c_mktsegment AS old_seg FROM customer)
SELECT k::BIGINT AS k, CASE WHEN old_seg IS NULL THEN 'added' WHEN seg IS NULL THEN 'removed' WHEN bal <> old_bal THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b USING (k)""")
def cdc_diff(t) -> DataFrame:
    both = first_version(t.customer).join(second_version(t.customer), "k", "full")
    status = F.when(F.col("old_seg").isNull(), "added").when(F.col("seg").isNull(), "removed").when(F.col("bal") != F.col("old_bal"), "changed").otherwise("same")
    return both.select("k", status.alias("status"))


@query(f"""WITH b AS ({_V2}), a AS (SELECT c_custkey AS k, c_acctbal AS old_bal, c_mktsegment AS old_seg FROM customer)
SELECT coalesce(seg, old_seg) AS segment, count(*) FILTER (old_seg IS NULL)::BIGINT AS n_added, count(*) FILTER (seg IS NULL)::BIGINT AS n_removed, count(*) FILTER (bal <> old_bal)::BIGINT AS n_changed FROM a FULL JOIN b USING (k) GROUP BY 1""")
def version_changelog(t) -> DataFrame:
    both = first_version(t.customer).join(second_version(t.customer), "k", "full")
    return both.groupBy(F.coalesce("seg", "old_seg").alias("segment")).agg(F.count_if(F.col("old_seg").isNull()).alias("n_added"), F.count_if(F.col("seg").isNull()).alias("n_removed"), F.count_if(F.col("bal") != F.col("old_bal")).alias("n_changed"))


@query(f"""WITH b AS ({_V2}), a AS (SELECT c_custkey AS k, c_acctbal AS old_bal, c_mktsegment AS old_seg FROM customer)
SELECT k::BIGINT AS k, round(CASE WHEN k % 5 = 0 THEN old_bal ELSE bal END, 2) AS bal, k % 5 = 0 AND bal <> old_bal AS retained FROM a JOIN b USING (k)""")
def locked_fields(t) -> DataFrame:
    both = first_version(t.customer).join(second_version(t.customer), "k")
    locked = F.col("k") % 5 == 0
    return both.select("k", F.round(F.when(locked, F.col("old_bal")).otherwise(F.col("bal")), 2).alias("bal"), (locked & (F.col("bal") != F.col("old_bal"))).alias("retained"))


@query("""SELECT c.c_custkey AS k, coalesce(o.seg, c.c_mktsegment) AS segment, o.seg IS NOT NULL AS overridden FROM customer c LEFT JOIN (SELECT c_custkey AS k, 'OVERRIDE' AS seg FROM customer WHERE c_custkey % 10 = 0) o ON o.k = c.c_custkey""")
def override_coalesce(t) -> DataFrame:
    override = t.customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("k"), F.lit("OVERRIDE").alias("seg"))
    joined = t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment").join(override, "k", "left")
    return joined.select("k", F.coalesce("seg", "c_mktsegment").alias("segment"), F.col("seg").isNotNull().alias("overridden"))


@query("""WITH base AS (SELECT * FROM events WHERE event_id % 3 <> 0), more AS (SELECT * FROM events WHERE event_id % 2 = 0), u AS (SELECT event_id, event_type FROM base UNION ALL SELECT event_id, event_type FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.event_id = m.event_id))
SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS n_ids FROM u GROUP BY event_type""")
def idempotent_append(t) -> DataFrame:
    base, more = t.events.filter("event_id % 3 <> 0"), t.events.filter("event_id % 2 = 0")
    out = base.unionByName(more.join(base.select("event_id"), "event_id", "left_anti").select(*base.columns))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("""SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'unjudged' WHEN toxic = 1 THEN 'withhold' WHEN quality = 1 THEN 'publish' ELSE 'keep previous' END AS decision, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL""")
def publication_gate(t) -> DataFrame:
    judged = t.documents.select("doc_id", "lang").join(t.labels.withColumn("judged", F.lit(True)), "doc_id", "left")
    decision = F.when(F.col("judged").isNull(), "unjudged").when(F.col("toxic") == 1, "withhold").when(F.col("quality") == 1, "publish").otherwise("keep previous")
    return judged.groupBy("lang", decision.alias("decision")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang AS meta_lang, n_chars AS meta_n_chars FROM documents")
def closed_projection(t) -> DataFrame:
    """Only the listed paths of a nested record leave it; Spark reads no other column."""
    nested = t.documents.select("doc_id", F.struct("lang", "n_chars", F.struct("source").alias("internal")).alias("meta"))
    return nested.select("doc_id", *(F.col(p).alias(p.replace(".", "_")) for p in ("meta.lang", "meta.n_chars")))


@query("""WITH d AS (SELECT l_orderkey AS id, unnest(list_filter(['A', 'B', 'C'], lambda x: (x = 'A' AND l_discount > 0.09) OR (x = 'B' AND l_quantity <= 1) OR (x = 'C' AND l_tax > 0.07 AND l_returnflag = 'R'))) AS defect FROM lineitem)
SELECT defect, count(*)::BIGINT AS n, min(id)::BIGINT AS first_id, max(id)::BIGINT AS last_id FROM d GROUP BY defect""")
def invariant_report(t) -> DataFrame:
    rules = {"A": F.col("l_discount") > 0.09, "B": F.col("l_quantity") <= 1, "C": (F.col("l_tax") > 0.07) & (F.col("l_returnflag") == "R")}
    defects = F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items())))
    found = t.lineitem.select(F.col("l_orderkey").alias("id"), F.explode(defects).alias("defect"))
    return found.groupBy("defect").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("""SELECT p_partkey AS k, 'size' AS field, p_size::VARCHAR AS value, 'measured' AS origin FROM part UNION ALL SELECT p_partkey, 'brand', p_brand, 'declared' FROM part UNION ALL SELECT p_partkey, 'type', p_type, 'declared' FROM part""")
def provenance_long(t) -> DataFrame:
    row = lambda f, c, o: F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value"), F.lit(o).alias("origin"))
    return t.part.select(F.col("p_partkey").alias("k"), F.inline(F.array(row("size", "p_size", "measured"), row("brand", "p_brand", "declared"), row("type", "p_type", "declared"))))


@query("""WITH j AS (SELECT p_brand AS brand, count(*) FILTER (l_returnflag = 'R')::BIGINT AS n_against, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n_for, count(*)::BIGINT AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand)
SELECT brand, n_for, n_against, CASE WHEN n_for > 2 * n_against THEN 'supported' WHEN n_against * 4 > n THEN 'contradicted' ELSE 'open' END AS status FROM j""")
def evidence_combine(t) -> DataFrame:
    joined = t.lineitem.select("l_partkey", "l_returnflag").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    told = joined.groupBy("brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_against"), F.count_if(F.col("l_returnflag") == "N").alias("n_for"), F.count("*").alias("n"))
    status = F.when(F.col("n_for") > 2 * F.col("n_against"), "supported").when(F.col("n_against") * 4 > F.col("n"), "contradicted").otherwise("open")
    return told.select("brand", "n_for", "n_against", status.alias("status"))


@query("""WITH c AS (SELECT n_chars AS x, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM labels JOIN documents USING (doc_id) GROUP BY n_chars),
w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT sum(p)::BIGINT AS n_positive, sum(n)::BIGINT AS n_negative, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6)::DOUBLE AS auc FROM w""")
def auc_midrank(t) -> DataFrame:
    """Ties count half. The running sum is over different lengths, in blocks of them, not over documents."""
    joined = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    counted = joined.groupBy("n_chars").agg(F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("n"))
    counted = counted.withColumn("block", F.floor(F.col("n_chars") / 256))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counted.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", before(Window.orderBy("block")).alias("blocks_below"))  # one row for 256 lengths
    inside = counted.withColumn("inside", before(Window.partitionBy("block").orderBy("n_chars")))
    ranked = inside.join(blocks, "block").withColumn("below", F.col("blocks_below") + F.col("inside"))
    return ranked.agg(F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"), F.round(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / (F.sum("p") * F.sum("n")), 6).alias("auc"))


@query("""SELECT (least(n_chars, 9999) // 1000)::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(quality), 6) AS mean_quality FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def calibration_bins(t) -> DataFrame:
    joined = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return joined.groupBy(F.floor(F.least(F.col("n_chars"), F.lit(9999)) / 1000).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("""WITH j AS (SELECT lang, source, toxic FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0 FROM j),
a AS (SELECT lang, count(*) FILTER (toxic = 1) AS a1, count(*) FILTER (toxic = 0) AS a0 FROM j GROUP BY lang), b AS (SELECT source, count(*) FILTER (toxic = 1) AS b1, count(*) FILTER (toxic = 0) AS b0 FROM j GROUP BY source),
k AS (SELECT DISTINCT lang, source FROM j)
SELECT lang, source, round(1 / (1 + exp((ln(n0 + 1.0) + ln((a0 + 1.0) / (n0 + 4.0)) + ln((b0 + 1.0) / (n0 + 20.0))) - (ln(n1 + 1.0) + ln((a1 + 1.0) / (n1 + 4.0)) + ln((b1 + 1.0) / (n1 + 20.0))))), 6) AS posterior FROM k JOIN a USING (lang) JOIN b USING (source), n""")
def naive_bayes_posterior(t) -> DataFrame:
    """Smoothed by one; one row a pair of values, so only counts are joined."""
    cells = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source").agg(F.count_if(F.col("toxic") == 1).alias("c1"), F.count_if(F.col("toxic") == 0).alias("c0"))
    total = lambda by, name: cells.groupBy(*by).agg(F.sum("c1").alias(f"{name}1"), F.sum("c0").alias(f"{name}0"))
    joined = cells.select("lang", "source").join(total(["lang"], "a"), "lang").join(total(["source"], "b"), "source").crossJoin(F.broadcast(total([], "n")))  # one row
    side = lambda c: F.log(F.col(f"n{c}") + 1.0) + F.log((F.col(f"a{c}") + 1.0) / (F.col(f"n{c}") + 4.0)) + F.log((F.col(f"b{c}") + 1.0) / (F.col(f"n{c}") + 20.0))
    return joined.select("lang", "source", F.round(1 / (1 + F.exp(side(0) - side(1))), 6).alias("posterior"))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 16 <> 0 AND EXISTS (SELECT 1 FROM orders q WHERE q.o_orderkey = o.o_orderkey - 1) THEN o_orderkey - 1 ELSE o_orderkey END AS up FROM orders o),
r AS (SELECT k, up, 0 AS hops FROM p UNION ALL SELECT r.k, p.up, hops + 1 FROM r JOIN p ON p.k = r.up WHERE p.up <> r.up)
SELECT k::BIGINT AS k, min(up)::BIGINT AS root FROM r GROUP BY k""")
def chain_resolution(t) -> DataFrame:
    """Each record's root over chains of at most 16 links: four rounds, each doubling what `up` spans."""
    key = F.col("o_orderkey")
    known = t.orders.select((key + 1).alias("k"), F.lit(True).alias("there"))
    links = t.orders.select(key.alias("k")).join(known, "k", "left").select("k", F.when(F.col("there") & (F.col("k") % 16 != 0), F.col("k") - 1).otherwise(F.col("k")).alias("up"))
    for _ in range(4):
        above = links.select(F.col("k").alias("up"), F.col("up").alias("top"))
        links = links.join(above, "up").select("k", F.col("top").alias("up"))
    return links.select("k", F.col("up").alias("root"))
