"""Closed formulas: units, flags, Julian days, the moon, map projection, tails of distributions, hulls, ribbons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.hulls import convex_hull
from heronry.operators.windows import epoch
from heronry.functions.tails import at_least, binomial_at_least, quantile
from heronry.plans.registry import query

_JD = "(s / 86400.0 + 2440587.5)"
_D = "(s / 86400.0 + 2440587.5 - 2451545.0)"


@query(f"WITH e AS (SELECT event_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS s FROM events) SELECT event_id, round({_JD}, 6) AS jd, round(((280.46061837 + 360.98564736629 * {_D}) % 360 + 360) % 360, 4) AS sidereal FROM e")
def julian_sidereal(t) -> DataFrame:
    """Julian day and mean sidereal time in degrees."""
    e = t.events.select("event_id", epoch("ts").alias("s"))
    days = F.col("s") / 86400.0 + 2440587.5
    return e.select("event_id", F.round(days, 6).alias("jd"), F.round(((280.46061837 + 360.98564736629 * (days - 2451545.0)) % 360 + 360) % 360, 4).alias("sidereal"))


_LON = f"radians(218.316 + 13.176396 * {_D} + 6.289 * sin(radians(134.963 + 13.064993 * {_D})))"
_LAT = f"radians(5.128 * sin(radians(93.272 + 13.229350 * {_D})))"
_DEC = f"asin(sin({_LAT}) * cos(radians(23.4397)) + cos({_LAT}) * sin(radians(23.4397)) * sin({_LON}))"
_RA = f"atan2(sin({_LON}) * cos(radians(23.4397)) - tan({_LAT}) * sin(radians(23.4397)), cos({_LON}))"
_HA = f"(radians(280.16 + 360.9856235 * {_D} + 10.0) - {_RA})"


@query(f"""WITH e AS (SELECT event_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS s FROM events)
SELECT event_id, round(degrees(asin(sin(radians(50.0)) * sin({_DEC}) + cos(radians(50.0)) * cos({_DEC}) * cos({_HA}))), 3) AS altitude, round((1 - cos(radians(360.0 * ({_D} - 5.1) / 29.530588853))) / 2, 5) AS lit FROM e""")
def moon_position(t) -> DataFrame:
    """Height of the moon at one place, in degrees, and its lit share, from its mean motion and largest terms."""
    d = F.col("s") / 86400.0 + 2440587.5 - 2451545.0
    angle = lambda a, b: F.radians(F.lit(a) + F.lit(b) * d)
    tilt, place = F.radians(F.lit(23.4397)), F.radians(F.lit(50.0))
    lon = F.radians(218.316 + 13.176396 * d + 6.289 * F.sin(angle(134.963, 13.064993)))
    lat = F.radians(5.128 * F.sin(angle(93.272, 13.229350)))
    dec = F.asin(F.sin(lat) * F.cos(tilt) + F.cos(lat) * F.sin(tilt) * F.sin(lon))
    right = F.atan2(F.sin(lon) * F.cos(tilt) - F.tan(lat) * F.sin(tilt), F.cos(lon))
    hour = angle(280.16 + 10.0, 360.9856235) - right
    up = F.degrees(F.asin(F.sin(place) * F.sin(dec) + F.cos(place) * F.cos(dec) * F.cos(hour)))
    lit = (1 - F.cos(F.radians(360.0 * (d - 5.1) / 29.530588853))) / 2
    return t.events.select("event_id", epoch("ts").alias("s")).select("event_id", F.round(up, 3).alias("altitude"), F.round(lit, 5).alias("lit"))


@query("""WITH p AS (SELECT c_custkey, radians(c_custkey * 37 % 1400 / 10.0 - 70) AS f, c_custkey * 91 % 3600 / 10.0 - 180 AS lon FROM customer), z AS (SELECT *, least(60, floor((lon + 180) / 6) + 1) AS zone FROM p),
v AS (SELECT *, 6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(f), 2)) AS n, pow(tan(f), 2) AS t, 0.00673949674228 * pow(cos(f), 2) AS c, cos(f) * radians(lon - (zone * 6 - 183)) AS a,
6378137.0 * ((1 - 0.00669437999014 / 4 - 3 * pow(0.00669437999014, 2) / 64 - 5 * pow(0.00669437999014, 3) / 256) * f - (3 * 0.00669437999014 / 8 + 3 * pow(0.00669437999014, 2) / 32 + 45 * pow(0.00669437999014, 3) / 1024) * sin(2 * f) + (15 * pow(0.00669437999014, 2) / 256 + 45 * pow(0.00669437999014, 3) / 1024) * sin(4 * f) - 35 * pow(0.00669437999014, 3) / 3072 * sin(6 * f)) AS m FROM z)
SELECT c_custkey, zone::INT AS zone, round(500000 + 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * 0.00673949674228) * pow(a, 5) / 120), 2) AS east,
round(0.9996 * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * 0.00673949674228) * pow(a, 6) / 720)) + CASE WHEN f < 0 THEN 10000000 ELSE 0 END, 2) AS north FROM v""")
def utm_forward(t) -> DataFrame:
    """Zone, easting and northing in metres, by the series of the transverse Mercator projection."""
    axis, flat, flat2 = 6378137.0, 0.00669437999014, 0.00673949674228
    k = F.col("c_custkey")
    p = t.customer.select(k, F.radians(k * 37 % 1400 / 10.0 - 70).alias("f"), (k * 91 % 3600 / 10.0 - 180).alias("lon"))
    p = p.withColumn("zone", F.least(F.lit(60), F.floor((F.col("lon") + 180) / 6) + 1))
    f = F.col("f")
    series = [1 - flat / 4 - 3 * flat**2 / 64 - 5 * flat**3 / 256, 3 * flat / 8 + 3 * flat**2 / 32 + 45 * flat**3 / 1024, 15 * flat**2 / 256 + 45 * flat**3 / 1024, 35 * flat**3 / 3072]
    p = p.withColumns({
        "n": axis / F.sqrt(1 - flat * F.pow(F.sin(f), 2)), "t": F.pow(F.tan(f), 2), "c": flat2 * F.pow(F.cos(f), 2), "a": F.cos(f) * F.radians(F.col("lon") - (F.col("zone") * 6 - 183)),
        "m": axis * (series[0] * f - series[1] * F.sin(2 * f) + series[2] * F.sin(4 * f) - series[3] * F.sin(6 * f)),
    })
    n, tt, c, a, m = (F.col(x) for x in "ntcam")
    east = 500000 + 0.9996 * n * (a + (1 - tt + c) * F.pow(a, 3) / 6 + (5 - 18 * tt + tt * tt + 72 * c - 58 * flat2) * F.pow(a, 5) / 120)
    north = 0.9996 * (m + n * F.tan(f) * (a * a / 2 + (5 - tt + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * tt + tt * tt + 600 * c - 330 * flat2) * F.pow(a, 6) / 720)) + F.when(f < 0, 10000000).otherwise(0)
    return p.select("c_custkey", F.col("zone").cast("int").alias("zone"), F.round(east, 2).alias("east"), F.round(north, 2).alias("north"))


#: Factors to the canonical unit of a magnitude (fixed values).
UNITS = {"km/h": ("m/s", 1 / 3.6), "kn": ("m/s", 1852 / 3600), "ft": ("m", 0.3048), "lb": ("kg", 0.45359237), "nm": ("m", 1852.0)}


@query("""WITH u AS (SELECT p_partkey AS k, p_size AS v, ['km/h', 'kn', 'ft', 'lb', 'nm', 'parsec'][CAST(p_partkey % 6 + 1 AS INT)] AS unit FROM part)
SELECT k, CASE unit WHEN 'km/h' THEN 'm/s' WHEN 'kn' THEN 'm/s' WHEN 'ft' THEN 'm' WHEN 'nm' THEN 'm' WHEN 'lb' THEN 'kg' END AS unit, round(v * CASE unit WHEN 'km/h' THEN 1 / 3.6 WHEN 'kn' THEN 1852.0 / 3600 WHEN 'ft' THEN 0.3048 WHEN 'lb' THEN 0.45359237 WHEN 'nm' THEN 1852.0 END, 6) AS v FROM u""")
def unit_conversion(t) -> DataFrame:
    """Values in the canonical unit of their magnitude; null for an unknown unit."""
    unit = F.element_at(F.array(*map(F.lit, [*UNITS, "parsec"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    to = F.create_map(*(x for u, (canonical, _) in UNITS.items() for x in (F.lit(u), F.lit(canonical))))
    by = F.create_map(*(x for u, (_, factor) in UNITS.items() for x in (F.lit(u), F.lit(float(factor)))))
    return t.part.select(F.col("p_partkey").alias("k"), F.try_element_at(to, unit).alias("unit"), F.round(F.col("p_size") * F.try_element_at(by, unit), 6).alias("v"))


@query("""SELECT p_brand AS brand, count(*) FILTER (p_partkey & 1 = 1)::BIGINT AS n_marked, count(*) FILTER (p_partkey & 1 = 0 AND p_type LIKE '%STEEL%')::BIGINT AS n_listed, count(*) FILTER (p_partkey & 1 = 0 AND p_type NOT LIKE '%STEEL%')::BIGINT AS n_other FROM part GROUP BY p_brand""")
def flag_bits(t) -> DataFrame:
    """Kinds by the first bit of a mask, else by a list of types."""
    marked, listed = F.col("p_partkey").bitwiseAND(1) == 1, F.col("p_type").contains("STEEL")
    return t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(marked).alias("n_marked"), F.count_if(~marked & listed).alias("n_listed"), F.count_if(~marked & ~listed).alias("n_other"))


@query("""WITH m AS (SELECT o_orderpriority AS kind, date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT kind, avg(n) AS mean, var_samp(n) AS var, arg_max(n, month) AS k FROM m GROUP BY kind),
r AS (SELECT *, CAST(mean + 40 * sqrt(greatest(mean, coalesce(var, 0))) + 100 + k AS BIGINT) AS upto, CASE WHEN var > 1.05 * mean THEN mean * mean / (var - mean) END AS r FROM s),
p AS (SELECT kind, k, mean, r, upto, list_transform(range(0, upto), lambda i: CASE WHEN r IS NULL THEN exp(-mean + i * ln(mean) - lgamma(i + 1)) ELSE exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * ln(r / (r + mean)) + i * ln(mean / (r + mean))) END) AS p FROM r),
q AS (SELECT kind, k, r, unnest(range(0, upto)) AS i, unnest(p) AS p FROM p), c AS (SELECT kind, k, r, i, p, sum(p) OVER (PARTITION BY kind ORDER BY i) AS cum FROM q)
SELECT kind, any_value(k)::BIGINT AS k, any_value(r) IS NOT NULL AS dispersed, round(1 - sum(p) FILTER (i < k), 6) AS upper_tail, min(i) FILTER (cum >= 0.1)::BIGINT AS q10, min(i) FILTER (cum >= 0.9)::BIGINT AS q90 FROM c GROUP BY kind""")
def count_tails(t) -> DataFrame:
    """Upper tail of the latest month's count, and the quantiles of the band, under Poisson or, if dispersed, the negative binomial."""
    m = t.orders.groupBy(F.col("o_orderpriority").alias("kind"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    s = m.groupBy("kind").agg(F.avg("n").alias("mean"), F.var_samp("n").alias("var"), F.max_by("n", "month").alias("k"))
    s = s.withColumn("r", F.when(F.col("var") > 1.05 * F.col("mean"), F.col("mean") * F.col("mean") / (F.col("var") - F.col("mean"))))
    r = F.col("r")
    tail = F.pandas_udf(lambda k, mean, r: pd.Series([at_least(int(a), b, None if c != c else c) for a, b, c in zip(k, mean, r)]), "double")
    band = lambda q: F.pandas_udf(lambda mean, r: pd.Series([quantile(q, b, None if c != c else c) for b, c in zip(mean, r)]), "long")
    r = r.cast("double")
    return s.select("kind", "k", r.isNotNull().alias("dispersed"), F.round(tail("k", "mean", r), 6).alias("upper_tail"), band(0.1)("mean", r).alias("q10"), band(0.9)("mean", r).alias("q90"))


@query("""WITH o AS (SELECT o_orderpriority AS kind, date_diff('month', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS back FROM orders), a AS (SELECT count(*) FILTER (back < 3) AS n, count(*) FILTER (back BETWEEN 3 AND 14) AS n0 FROM o),
g AS (SELECT kind, count(*) FILTER (back < 3) AS k, count(*) FILTER (back BETWEEN 3 AND 14) AS k0 FROM o GROUP BY kind), p AS (SELECT kind, k, n, (k0 + 1.0) / (n0 + 2.0) AS p FROM g, a)
SELECT kind, round(k / n - p, 6) AS change, round(coalesce(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))), 0), 6) AS tail FROM p WHERE n > 0""")
def binomial_tail(t) -> DataFrame:
    """Change of each kind's share in the last three months against the twelve before, with its exact upper tail."""
    last = t.orders.agg(F.max(F.to_date("o_orderdate")).alias("last"))
    day = F.to_date("o_orderdate")
    back = (F.year("last") - F.year(day)) * 12 + F.month("last") - F.month(day)
    o = t.orders.crossJoin(F.broadcast(last)).select(F.col("o_orderpriority").alias("kind"), back.alias("back"))  # one row
    g = o.groupBy("kind").agg(F.count_if(F.col("back") < 3).alias("k"), F.count_if(F.col("back").between(3, 14)).alias("k0"))
    p = g.crossJoin(F.broadcast(g.agg(F.sum("k").alias("n"), F.sum("k0").alias("n0")))).filter("n > 0").withColumn("p", (F.col("k0") + 1.0) / (F.col("n0") + 2.0))
    tail = F.pandas_udf(lambda k, n, p: pd.Series([binomial_at_least(int(a), int(b), c) for a, b, c in zip(k, n, p)]), "double")
    return p.select("kind", F.round(F.col("k") / F.col("n") - F.col("p"), 6).alias("change"), F.round(tail("k", "n", "p"), 6).alias("tail"))


_ROUTE = "SELECT c_nationkey AS route, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, CAST(c_custkey * 37 % 100 AS DOUBLE) AS x, CAST(c_custkey * 91 % 100 AS DOUBLE) AS y FROM customer"


@query(f"""WITH p AS ({_ROUTE}), n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY route ORDER BY i)),
c AS (SELECT route, i * 2 AS j, 0.75 * x + 0.25 * x2 AS x, 0.75 * y + 0.25 * y2 AS y FROM n WHERE x2 IS NOT NULL UNION ALL SELECT route, i * 2 + 1, 0.25 * x + 0.75 * x2, 0.25 * y + 0.75 * y2 FROM n WHERE x2 IS NOT NULL),
d AS (SELECT route, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY route ORDER BY j))
SELECT route, count(*)::BIGINT AS n, round(sum(sqrt(pow(x - x0, 2) + pow(y - y0, 2))), 4) AS length FROM d GROUP BY route""")
def smoothed_routes(t) -> DataFrame:
    """Routes with their corners cut once, as many points as that takes, and their length."""
    k = F.col("c_custkey")
    point = F.struct(k.alias("k"), (k * 37 % 100).cast("double").alias("x"), (k * 91 % 100).cast("double").alias("y"))
    line = t.customer.groupBy(F.col("c_nationkey").alias("route")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    mix = lambda a, b, w: F.struct((w * a["x"] + (1 - w) * b["x"]).alias("x"), (w * a["y"] + (1 - w) * b["y"]).alias("y"))
    cut = F.flatten(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.array(mix(a, b, 0.75), mix(a, b, 0.25))))
    smooth = line.filter(F.size("p") > 1).withColumn("c", cut)
    step = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))
    return smooth.select("route", F.size("c").cast("long").alias("n"), F.round(F.aggregate(step, F.lit(0.0), lambda s, x: s + x), 4).alias("length"))


@query()
def hull_of_sites(t) -> DataFrame:
    """Corners of the hull around each nation's customers, counterclockwise from the leftmost."""
    k = F.col("c_custkey")
    points = t.customer.select(F.col("c_nationkey").alias("nation"), (k * 37 % 1400 / 10.0 - 70).alias("y"), (k * 91 % 3600 / 10.0 - 180).alias("x"))
    return convex_hull(points, "nation", "x", "y")
