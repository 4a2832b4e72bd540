"""Counts per month and week: scores, shares, registers, resampling, a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numbers import ln_gamma, poisson_log_pmf
from heronry.operators.graphs import cut
from heronry.operators.windows import densify
from heronry.plans.registry import query

_MONTHS = """c AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS m, count(*)::BIGINT AS n FROM orders GROUP BY ALL),
g AS (SELECT p, m::DATE AS m FROM (SELECT DISTINCT p FROM c), (SELECT unnest(generate_series((SELECT min(m) FROM c), (SELECT max(m) FROM c), INTERVAL 1 MONTH)) AS m)),
q AS (SELECT g.p, g.m, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c ON c.p = g.p AND c.m = g.m)"""


def monthly(orders: DataFrame) -> DataFrame:
    """(p, m, n): orders of each priority and month, with zeros; only these counts meet in the windows below."""
    counted = orders.groupBy(F.col("o_orderpriority").alias("p"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.count("*").alias("n"))
    return densify(counted, ["p"], "m", "n", step="1 month")


def mean_before(value: str):
    return F.avg(value).over(Window.partitionBy("p").orderBy("m").rowsBetween(Window.unboundedPreceding, -1))


@query("""WITH b AS (SELECT date_trunc('month', max(o_orderdate)) AS last FROM orders),
s AS (SELECT o_orderpriority AS p, count(*) FILTER (o_orderdate >= last - INTERVAL 2 MONTH) AS n1, count(*) FILTER (o_orderdate >= last - INTERVAL 2 MONTH AND o_orderstatus = 'F') AS k1,
count(*) FILTER (o_orderdate < last - INTERVAL 2 MONTH) AS n0, count(*) FILTER (o_orderdate < last - INTERVAL 2 MONTH AND o_orderstatus = 'F') AS k0 FROM orders, b WHERE o_orderdate >= last - INTERVAL 14 MONTH GROUP BY 1)
SELECT p AS priority, n1::BIGINT AS n_now, n0::BIGINT AS n_before, round(k1 / n1, 6) AS share_now, round(k0 / n0, 6) AS share_before,
round((k1 / n1 - k0 / n0) / sqrt((k1 + k0) / (n1 + n0) * (1 - (k1 + k0) / (n1 + n0)) * (1 / n1 + 1 / n0)), 6) AS z FROM s WHERE n1 > 0 AND n0 > 0 AND k1 + k0 BETWEEN 1 AND n1 + n0 - 1""")
def binomial_share_change(t) -> DataFrame:
    """Share of finished orders in the last three months against the twelve before, as a normal deviate of the pooled share."""
    last = t.orders.agg(F.date_trunc("month", F.max("o_orderdate")).cast("timestamp_ntz").alias("last"))
    split = F.col("last") - F.expr("interval 2 months")
    dated = t.orders.select("o_orderpriority", "o_orderstatus", "o_orderdate").crossJoin(F.broadcast(last))  # one row
    dated = dated.filter(F.col("o_orderdate") >= F.col("last") - F.expr("interval 14 months"))
    now, done = F.col("o_orderdate") >= split, F.col("o_orderstatus") == "F"
    s = dated.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(now).alias("n1"), F.count_if(now & done).alias("k1"), F.count_if(~now).alias("n0"), F.count_if(~now & done).alias("k0"))
    n1, k1, n0, k0 = (F.col(c) for c in ("n1", "k1", "n0", "k0"))
    pooled = (k1 + k0) / (n1 + n0)
    z = (k1 / n1 - k0 / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    return s.filter((n1 > 0) & (n0 > 0) & (k1 + k0).between(1, n1 + n0 - 1)).select("priority", n1.alias("n_now"), n0.alias("n_before"), F.round(k1 / n1, 6).alias("share_now"), F.round(k0 / n0, 6).alias("share_before"), F.round(z, 6).alias("z"))


@query(f"""WITH {_MONTHS}, w AS (SELECT p, m, n, row_number() OVER o AS i, avg(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean, lag(n) OVER o AS last, CASE WHEN n > lag(n) OVER o THEN 1 ELSE 0 END AS up FROM q WINDOW o AS (PARTITION BY p ORDER BY m)),
v AS (SELECT *, avg(up) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pu, lag(up) OVER o AS lu FROM w WINDOW o AS (PARTITION BY p ORDER BY m))
SELECT p AS priority, count(*)::BIGINT AS n_scored, round(avg(n * ln(greatest(mean, 0.1)) - greatest(mean, 0.1) - lgamma(n + 1)), 6) AS log_mean, round(avg(n * ln(greatest(last, 0.1)) - greatest(last, 0.1) - lgamma(n + 1)), 6) AS log_persistence,
round(avg((pu - up) * (pu - up)), 6) AS brier_mean, round(avg((lu - up) * (lu - up)), 6)::DOUBLE AS brier_persistence FROM v WHERE i > 12 GROUP BY p""")
def walk_forward_score(t) -> DataFrame:
    """Each month forecast from the months before it: their mean against the last one, by Poisson log score and, for a rise, Brier score."""
    o = Window.partitionBy("p").orderBy("m")
    last = F.lag("n").over(o)
    w = monthly(t.orders).withColumns({"i": F.row_number().over(o), "mean": mean_before("n"), "last": last, "up": F.when(F.col("n") > last, 1).otherwise(0)})
    v = w.withColumns({"pu": mean_before("up"), "lu": F.lag("up").over(o)}).filter("i > 12")
    score = lambda c: F.round(F.avg(poisson_log_pmf(F.col("n"), F.greatest(F.col(c).cast("double"), F.lit(0.1)))), 6)
    brier = lambda c: F.round(F.avg((F.col(c) - F.col("up")) * (F.col(c) - F.col("up"))), 6)
    return v.groupBy(F.col("p").alias("priority")).agg(F.count("*").alias("n_scored"), score("mean").alias("log_mean"), score("last").alias("log_persistence"), brier("pu").alias("brier_mean"), brier("lu").alias("brier_persistence"))


@query(f"""WITH {_MONTHS}, s AS (SELECT p, avg(n) AS mean, var_samp(n) AS v, arg_max(n, m) AS y FROM q GROUP BY p), r AS (SELECT *, CASE WHEN v > mean THEN mean * mean / (v - mean) END AS r FROM s)
SELECT p AS priority, y::BIGINT AS y, round(mean, 6) AS mean, round(y * ln(mean) - mean - lgamma(y + 1), 6) AS log_poisson,
round(lgamma(y + r) - lgamma(r) - lgamma(y + 1) + r * ln(r / (r + mean)) + y * ln(mean / (r + mean)), 6) AS log_negative_binomial, round(greatest(0, mean - 1.2816 * sqrt(v)), 6) AS low, round(mean + 1.2816 * sqrt(v), 6) AS high FROM r""")
def poisson_nb_scores(t) -> DataFrame:
    """The last month under a Poisson and, where counts vary more than that, a negative binomial law; the central 80 % band."""
    s = monthly(t.orders).groupBy("p").agg(F.avg("n").alias("mean"), F.var_samp("n").alias("v"), F.max_by("n", "m").alias("y"))
    s = s.withColumn("r", F.when(F.col("v") > F.col("mean"), F.col("mean") * F.col("mean") / (F.col("v") - F.col("mean"))))
    y, mean, r, spread = F.col("y"), F.col("mean"), F.col("r"), 1.2816 * F.sqrt("v")
    nb = ln_gamma(y + r) - ln_gamma(r) - ln_gamma(y + 1) + r * F.log(r / (r + mean)) + y * F.log(mean / (r + mean))
    return s.select(F.col("p").alias("priority"), "y", F.round(mean, 6).alias("mean"), F.round(poisson_log_pmf(y, mean), 6).alias("log_poisson"), F.round(nb, 6).alias("log_negative_binomial"), F.round(F.greatest(F.lit(0.0), mean - spread), 6).alias("low"), F.round(mean + spread, 6).alias("high"))


@query(f"""WITH {_MONTHS}, w AS (SELECT p, m, n, lag(n, 1) OVER o AS a, lag(n, 2) OVER o AS b FROM q WINDOW o AS (PARTITION BY p ORDER BY m)),
f AS (SELECT p, m, a::DOUBLE AS predicted, 'first' AS run FROM w WHERE a IS NOT NULL AND month(m) % 3 <> 0), s AS (SELECT p, m, (a + b) / 2 AS predicted, 'second' AS run FROM w WHERE b IS NOT NULL),
r AS (SELECT * FROM f UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.p = s.p AND f.m = s.m))
SELECT r.p AS priority, r.m AS month, run, predicted, n AS outcome, abs(predicted - n) * 10 > n AS missed FROM r JOIN q ON q.p = r.p AND q.m = r.m""")
def forecast_register(t) -> DataFrame:
    """Predictions are only added: a later run can't replace one that stands. Outcomes are joined when they are known."""
    q = monthly(t.orders)
    o = Window.partitionBy("p").orderBy("m")
    w = q.select("p", "m", F.lag("n", 1).over(o).alias("a"), F.lag("n", 2).over(o).alias("b"))
    first = w.filter(F.col("a").isNotNull() & (F.month("m") % 3 != 0)).select("p", "m", F.col("a").cast("double").alias("predicted"), F.lit("first").alias("run"))
    second = w.filter("b is not null").select("p", "m", ((F.col("a") + F.col("b")) / 2).alias("predicted"), F.lit("second").alias("run"))
    register = first.unionByName(second.join(first, ["p", "m"], "left_anti"))
    told = register.join(q.withColumnRenamed("n", "outcome"), ["p", "m"])
    return told.select(F.col("p").alias("priority"), F.col("m").alias("month"), "run", "predicted", "outcome", (F.abs(F.col("predicted") - F.col("outcome")) * 10 > F.col("outcome")).alias("missed"))


N_RESAMPLES = 1000


@query(f"""WITH w AS (SELECT date_diff('day', DATE '1970-01-05', o_orderdate::DATE) // 7 AS week, count(*)::BIGINT AS n FROM orders GROUP BY 1),
g AS (SELECT week, n, lag(n, 1) OVER (ORDER BY week) AS a, lag(n, 2) OVER (ORDER BY week) AS b FROM w), d AS (SELECT row_number() OVER (ORDER BY week) - 1 AS i, abs(n - b) - abs(n - a) AS gain FROM g WHERE b IS NOT NULL),
k AS (SELECT count(*) AS k FROM d), x AS (SELECT r, ((r * 7919 + j * 104729 + 12345) * 1103515245 % 2147483648) // 65536 % k AS i, k FROM k, range({N_RESAMPLES}) AS s(r), range(100000) AS u(j) WHERE j < k),
m AS (SELECT r, sum(gain) / any_value(k) AS mean FROM x JOIN d USING (i) GROUP BY r)
SELECT (SELECT k FROM k)::BIGINT AS n_blocks, (SELECT round(avg(gain), 6) FROM d) AS gain, round(list_sort(list(mean))[{N_RESAMPLES // 10 + 1}], 6) AS lower_bound FROM m""")
def block_bootstrap_lb(t) -> DataFrame:
    """P10 of the mean gain of the last week over the one before it, as forecasts, over resampled weeks; the draws come from a fixed generator."""
    week = F.floor(F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-05").cast("date")) / 7)
    weekly = t.orders.groupBy(week.alias("week")).agg(F.count("*").alias("n"))
    o = Window.orderBy("week")  # one row a week
    gains = weekly.select("week", "n", F.lag("n", 1).over(o).alias("a"), F.lag("n", 2).over(o).alias("b")).filter("b is not null")
    d = gains.select((F.row_number().over(o) - 1).cast("long").alias("i"), (F.abs(F.col("n") - F.col("b")) - F.abs(F.col("n") - F.col("a"))).alias("gain"))
    known = d.agg(F.count("*").alias("k"), F.round(F.avg("gain"), 6).alias("gain")).filter("k > 0")
    draws = t.spark.range(N_RESAMPLES).withColumnRenamed("id", "r").crossJoin(F.broadcast(known.select("k"))).select("r", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    i = F.floor(F.pmod((F.col("r") * 7919 + F.col("j") * 104729 + 12345) * 1103515245, F.lit(2147483648)) / 65536) % F.col("k")
    means = draws.select("r", "k", i.alias("i")).join(d, "i").groupBy("r").agg((F.sum("gain") / F.first("k")).alias("mean"))
    bound = means.agg(F.round(F.element_at(F.array_sort(F.collect_list("mean")), N_RESAMPLES // 10 + 1), 6).alias("lower_bound"))
    return known.crossJoin(bound).select(F.col("k").alias("n_blocks"), "gain", "lower_bound")


#: Steps of the twin; Newton's have long settled by then.
STEPS = 14
_STEP = """b{1} AS (SELECT lang, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM (SELECT lang, any_value(b0) AS b0, any_value(b1) AS b1,
sum(n * (y - p)) AS g0, sum(n * x * (y - p)) - 0.01 * any_value(b1) AS g1, sum(n * p * (1 - p)) AS h00, sum(n * x * p * (1 - p)) AS h01, sum(n * x * x * p * (1 - p)) + 0.01 AS h11
FROM (SELECT c.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM c JOIN b{0} USING (lang)) GROUP BY lang))"""


@query(f"""WITH c AS MATERIALIZED (SELECT lang, round(ln(1.0 + n_chars), 1)::DOUBLE - 6 AS x, quality AS y, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
b0 AS MATERIALIZED (SELECT lang, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM c GROUP BY lang HAVING min(y) < max(y)), {", ".join(_STEP.format(k, k + 1).replace(" AS (", " AS MATERIALIZED (", 1) for k in range(STEPS))}
SELECT lang, round(b0, 5) AS b0, round(b1, 5) AS b1 FROM b{STEPS}""")
def logistic_newton(t) -> DataFrame:
    """Good or bad by length, per language, with Newton's steps on counted cells: each step is five sums a language. The intercept isn't penalised; it ends when no step reaches 1e-8."""
    joined = t.labels.filter("quality is not null").join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    cells = joined.groupBy("lang", (F.round(F.log(1.0 + F.col("n_chars")), 1) - 6).alias("x"), F.col("quality").alias("y")).agg(F.count("*").alias("n"))
    cells = cut(cells)
    both = cells.groupBy("lang").agg((F.min("y") < F.max("y")).alias("both")).filter("both")
    b = both.select("lang", F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"))
    n, x, y, p = (F.col(c) for c in "nxyp")
    for _ in range(40):
        told = cells.join(b, "lang").withColumn("p", 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * x))))
        s = told.groupBy("lang", "b0", "b1").agg(F.sum(n * (y - p)).alias("g0"), F.sum(n * x * (y - p)).alias("g1"), F.sum(n * p * (1 - p)).alias("h00"), F.sum(n * x * p * (1 - p)).alias("h01"), F.sum(n * x * x * p * (1 - p)).alias("h11"))
        g0, g1 = F.col("g0"), F.col("g1") - 0.01 * F.col("b1")
        h00, h01, h11 = F.col("h00"), F.col("h01"), F.col("h11") + 0.01
        det = h00 * h11 - h01 * h01
        step0, step1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        moved = cut(s.select("lang", (F.col("b0") + step0).alias("b0"), (F.col("b1") + step1).alias("b1"), F.greatest(F.abs(step0), F.abs(step1)).alias("step")))
        b = moved.drop("step")
        if (moved.agg(F.max("step")).first()[0] or 0.0) < 1e-8:
            break
    return b.select("lang", F.round("b0", 5).alias("b0"), F.round("b1", 5).alias("b1"))
