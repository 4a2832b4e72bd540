"""What sentences say: numbers, times, dates, features with negation, tracking lines, encounters, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.readings import NUMBERS, UNIT_METRES, clock_minutes, dates_in, duration_minutes, features_in, number_range, transliterated
from heronry.plans.registry import query

#: Sentences made from keys, one expression for both sides.
_COUNTED = "CASE o_orderkey % 8 WHEN 0 THEN 'between two and five drones were shot down' WHEN 1 THEN 'Twelve drones fell' WHEN 2 THEN 'zwanzig Drohnen über der Stadt' WHEN 3 THEN 'entre tres y siete drones' WHEN 4 THEN o_custkey % 90 || ' of 120 drones' WHEN 5 THEN 'from ' || o_custkey % 9 || ' to ' || (o_custkey % 9 + 4) || ' targets' WHEN 6 THEN 'a dozen drones' ELSE 'no count is given' END"
_NUMBER_CASE = "CASE {0} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in NUMBERS.items()) + " ELSE TRY_CAST({0} AS INT) END"
_NUMBER_WORD = "(" + "|".join(sorted(NUMBERS, key=lambda w: (-len(w), w))) + "|[0-9]+)"


@query(f"""WITH s AS (SELECT o_orderkey AS id, lower({_COUNTED}) AS s FROM orders),
r AS (SELECT id, s, regexp_extract(s, '(?:between|from|entre|zwischen) {_NUMBER_WORD} (?:and|to|y|und) {_NUMBER_WORD}(?:[^a-z0-9]|$)', ['a', 'b']) AS r, regexp_extract(s, '(?:^|[^a-z0-9]){_NUMBER_WORD}(?:[^a-z0-9]|$)', 1) AS one FROM s)
SELECT id, CASE WHEN r.a <> '' THEN {_NUMBER_CASE.format("r.a")} ELSE {_NUMBER_CASE.format("one")} END AS low, CASE WHEN r.a <> '' THEN {_NUMBER_CASE.format("r.b")} ELSE {_NUMBER_CASE.format("one")} END AS high FROM r""")
def number_words(t) -> DataFrame:
    """Counts in words or digits, single or as a range, in several languages."""
    found = number_range(F.expr(_COUNTED))
    return t.orders.select(F.col("o_orderkey").alias("id"), found["low"].alias("low"), found["high"].alias("high"))


_TIMED = "CASE o_orderkey % 6 WHEN 0 THEN 'closed from ' || o_custkey % 24 || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ' to 6 am' WHEN 1 THEN 'at ' || (o_custkey % 12 + 1) || ' pm' WHEN 2 THEN 'lasted ' || o_custkey % 5 || ' hours ' || o_orderkey % 60 || ' minutes' WHEN 3 THEN 'for ' || o_custkey % 90 || ' min' WHEN 4 THEN 'half past nothing' ELSE 'seen at 23.45 h' END"


@query(f"""WITH s AS (SELECT o_orderkey AS id, {_TIMED.replace("VARCHAR), 2", "VARCHAR), 2")} AS s FROM orders),
c AS (SELECT id, s, regexp_extract_all(s, '[0-9]{{1,2}}[:.][0-9]{{2}}|[0-9]{{1,2}} (?:am|pm)') AS c, regexp_extract(s, '([0-9]+) hours?', 1) AS h, regexp_extract(s, '([0-9]+) min', 1) AS m FROM s),
d AS (SELECT id, list_transform(c, lambda x: CASE WHEN regexp_matches(x, '[ap]m') THEN (CAST(regexp_extract(x, '[0-9]+') AS INT) % 12 + CASE WHEN x LIKE '%pm' THEN 12 ELSE 0 END) * 60 ELSE CAST(regexp_extract(x, '^[0-9]+') AS INT) * 60 + CAST(regexp_extract(x, '[0-9]{{2}}$') AS INT) END) AS t, h, m FROM c)
SELECT id, t[1] AS start, t[2] AS "end", CASE WHEN h = '' AND m = '' THEN NULL ELSE coalesce(TRY_CAST(h AS INT), 0) * 60 + coalesce(TRY_CAST(m AS INT), 0) END AS lasted FROM d""")
def clock_times(t) -> DataFrame:
    """Clock times of a sentence in minutes after midnight, and durations in minutes."""
    said = F.expr(_TIMED.replace("VARCHAR", "STRING"))
    times = clock_minutes(said)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.get(times, F.lit(0)).alias("start"), F.get(times, F.lit(1)).alias("end"), duration_minutes(said).alias("lasted"))


_DATED = "CASE o_orderkey % 8 WHEN 0 THEN 'it fell yesterday' WHEN 1 THEN 'anoche hubo alarma' WHEN 2 THEN 'vor ' || (o_custkey % 9 + 1) || ' Tagen gesehen' WHEN 3 THEN o_custkey % 9 + 1 || ' days ago' WHEN 4 THEN 'on ' || (o_custkey % 28 + 1) || ' March' WHEN 5 THEN 'am ' || (o_custkey % 28 + 1) || '. Dezember' WHEN 6 THEN 'el ' || (o_custkey % 28 + 1) || ' de mayo' ELSE 'some day' END"
_MONTH = "CASE {0} WHEN 'march' THEN 3 WHEN 'dezember' THEN 12 WHEN 'mayo' THEN 5 END"


@query(f"""WITH s AS (SELECT o_orderkey AS id, lower({_DATED}) AS s, CAST(o_orderdate AS DATE) AS told FROM orders),
p AS (SELECT id, told, s, regexp_extract(s, '(?:vor ([0-9]+) tagen|([0-9]+) days ago)', ['a', 'b']) AS ago, regexp_extract(s, '([0-9]{{1,2}})\\.?(?: de)? ([a-z]+)', ['d', 'm']) AS dm FROM s),
d AS (SELECT id, told, s, ago, CASE WHEN {_MONTH.format("dm.m")} IS NULL THEN NULL ELSE make_date(year(told), {_MONTH.format("dm.m")}, TRY_CAST(dm.d AS INT)) END AS named FROM p)
SELECT id, CAST(CASE WHEN s LIKE '%yesterday%' OR s LIKE '%anoche%' THEN told - 1 WHEN ago.a <> '' THEN told - TRY_CAST(ago.a AS INT) WHEN ago.b <> '' THEN told - TRY_CAST(ago.b AS INT) WHEN named > told THEN CAST(named - INTERVAL 1 YEAR AS DATE) ELSE named END AS VARCHAR) AS day FROM d""")
def date_from_sentence(t) -> DataFrame:
    """The day that a sentence means, seen from the day it was told; a named day that is still to come is last year's."""
    return t.orders.select(F.col("o_orderkey").alias("id"), dates_in(F.expr(_DATED), F.to_date("o_orderdate")).cast("string").alias("day"))


_FEATURED = "lower(CASE p_partkey % 6 WHEN 0 THEN 'a jet engine and a delta wing, no propeller' WHEN 1 THEN 'without any sign of a propeller; loud' WHEN 2 THEN 'it was not very loud and had a delta wing' WHEN 3 THEN 'propeller noise, not seen' WHEN 4 THEN 'never a jet' ELSE p_name END)"


@query(f"""WITH w AS (SELECT p_partkey AS k, regexp_extract_all({_FEATURED}, '[a-z]+') AS w FROM part),
p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT k, w[i] AS feature, len(list_filter(w[greatest(1, i - 3):i - 1], lambda x: x IN ('no', 'not', 'never', 'without'))) > 0 AS negated FROM p WHERE w[i] IN ('jet', 'propeller', 'delta', 'loud'))
SELECT k, string_agg(CASE WHEN negated THEN '-' ELSE '+' END || feature, ',' ORDER BY feature, negated) AS features FROM f GROUP BY k""")
def negated_features(t) -> DataFrame:
    """Features that a text names, with those that a word of negation stands at most three words before."""
    found = t.part.select(F.col("p_partkey").alias("k"), features_in(F.expr(_FEATURED), ["jet", "propeller", "delta", "loud"], ["no", "not", "never", "without"]).alias("f")).filter(F.size("f") > 0)
    told = F.transform(F.array_sort("f"), lambda x: F.concat(F.when(x["negated"], "-").otherwise("+"), x["feature"]))
    return found.select("k", F.array_join(told, ",").alias("features"))


_TRACKED = "'Zone ' || (o_custkey % 7) || ': ' || (o_orderkey % 5 + 1) || ' -> SW toward ' || o_orderpriority || chr(10) || 'free text' || chr(10) || 'Zone ' || (o_custkey % 3) || ': 2 -> N'"


@query(f"""WITH l AS (SELECT o_orderkey AS id, unnest(string_split({_TRACKED}, chr(10))) AS line FROM orders), p AS (SELECT id, regexp_extract(line, '^Zone ([0-9]+): ([0-9]+) -> ([NSEW]{{1,2}})(?: toward (.+))?$', ['zone', 'n', 'heading', 'destination']) AS p FROM l)
SELECT id, CAST(p.zone AS INT) AS zone, CAST(p.n AS INT) AS n, p.heading AS heading, nullif(p.destination, '') AS destination FROM p WHERE p.zone <> ''""")
def tracking_lines(t) -> DataFrame:
    """Lines of a tracking message: zone, count, heading and, where it is named, destination."""
    lines = t.orders.select(F.col("o_orderkey").alias("id"), F.explode(F.split(F.expr(_TRACKED), "\n")).alias("line"))
    part = lambda k: F.regexp_extract("line", r"^Zone ([0-9]+): ([0-9]+) -> ([NSEW]{1,2})(?: toward (.+))?$", k)
    return lines.filter(part(1) != "").select("id", part(1).cast("int").alias("zone"), part(2).cast("int").alias("n"), part(3).alias("heading"), F.nullif(part(4), F.lit("")).alias("destination"))


_MET = "CASE l_partkey % 4 WHEN 0 THEN 'sep ' || l_suppkey * 10 || 'ft V/' || l_linenumber * 100 || 'm H at FL' || l_partkey % 300 WHEN 1 THEN 'separation ' || l_linenumber || 'nm H, alt ' || l_suppkey * 100 || 'ft, a quadcopter' WHEN 2 THEN 'fixed wing model, 30m V' ELSE 'not assessed' END"


@query(f"""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, {_MET} AS s FROM lineitem),
p AS (SELECT *, regexp_extract(s, '([0-9]+)(ft|m|nm) V', ['n', 'u']) AS v, regexp_extract(s, '([0-9]+)(ft|m|nm) H', ['n', 'u']) AS h, regexp_extract(s, 'FL([0-9]+)', 1) AS fl, regexp_extract(s, 'alt ([0-9]+)ft', 1) AS alt FROM s)
SELECT id, line, part, round(CAST(nullif(v.n, '') AS DOUBLE) * CASE v.u WHEN 'ft' THEN 0.3048 WHEN 'nm' THEN 1852.0 ELSE 1.0 END, 2) AS vertical_m, round(CAST(nullif(h.n, '') AS DOUBLE) * CASE h.u WHEN 'ft' THEN 0.3048 WHEN 'nm' THEN 1852.0 ELSE 1.0 END, 2) AS horizontal_m,
coalesce(CAST(nullif(fl, '') AS INT) * 100, CAST(nullif(alt, '') AS INT)) AS altitude_ft, CASE WHEN s LIKE '%quadcopter%' THEN 'rotor' WHEN s LIKE '%fixed wing%' THEN 'wing' ELSE 'unknown' END AS class FROM p""")
def encounter_separation(t) -> DataFrame:
    """Separations in metres, altitude and class from the words of an encounter report."""
    s = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.expr(_MET).alias("s"))

    def metres(axis: str) -> Column:
        n, unit = (F.regexp_extract("s", rf"([0-9]+)(ft|m|nm) {axis}", k) for k in (1, 2))
        return F.round(F.nullif(n, F.lit("")).cast("double") * F.coalesce(*(F.when(unit == u, m) for u, m in UNIT_METRES.items()), F.lit(1.0)), 2)

    number = lambda pattern: F.nullif(F.regexp_extract("s", pattern, 1), F.lit("")).cast("int")
    kind = F.when(F.col("s").contains("quadcopter"), "rotor").when(F.col("s").contains("fixed wing"), "wing").otherwise("unknown")
    return s.select("id", "line", "part", metres("V").alias("vertical_m"), metres("H").alias("horizontal_m"), F.coalesce(number("FL([0-9]+)") * 100, number("alt ([0-9]+)ft")).alias("altitude_ft"), kind.alias("class"))


_TITLED = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' - The Daily Post' WHEN 1 THEN ' | news24.example' WHEN 2 THEN ' – ' || p_brand ELSE '' END"


@query(f"SELECT p_partkey AS k, regexp_replace({_TITLED}, '\\s+[-|–]\\s+[^-|–]{{2,40}}$', '') AS headline FROM part")
def outlet_suffix(t) -> DataFrame:
    """Headlines without the outlet's name at the end."""
    return t.part.select(F.col("p_partkey").alias("k"), F.regexp_replace(F.expr(_TITLED), r"\s+[-|–]\s+[^-|–]{2,40}$", "").alias("headline"))


@query("SELECT p_partkey AS k, lower(p_name) AS latin FROM part WHERE regexp_matches(lower(p_name), '^[abdefgiklmnoprstuvz ]+$')")
def transliteration(t) -> DataFrame:
    """Cyrillic letters to Latin ones; names that were written in Cyrillic come back."""
    written = F.translate(F.lower("p_name"), "abdefgiklmnoprstuvz", "абдефгиклмнопрстувз")
    return t.part.filter(F.lower("p_name").rlike("^[abdefgiklmnoprstuvz ]+$")).select(F.col("p_partkey").alias("k"), transliterated(written).alias("latin"))


@query("""WITH k AS (SELECT s_suppkey, concat_ws('#', 'place', replace(s_name, '#', '_'), s_nationkey, s_suppkey * 37 % 1400 - 700, s_suppkey * 91 % 3600 - 1800) AS key FROM supplier)
SELECT s_suppkey, key, string_split(key, '#')[2] AS name, CAST(string_split(key, '#')[3] AS INT) AS nation, CAST(string_split(key, '#')[4] AS INT) / 10.0 AS lat, CAST(string_split(key, '#')[5] AS INT) / 10.0 AS lon FROM k""")
def pseudo_keys(t) -> DataFrame:
    """Ids that carry the fields of a place, made and read again."""
    k = F.col("s_suppkey")
    made = t.supplier.select(k, F.concat_ws("#", F.lit("place"), F.replace("s_name", F.lit("#"), F.lit("_")), "s_nationkey", k * 37 % 1400 - 700, k * 91 % 3600 - 1800).alias("key"))
    part = lambda n: F.get(F.split("key", "#"), F.lit(n))
    return made.select("s_suppkey", "key", part(1).alias("name"), part(2).cast("int").alias("nation"), (part(3).cast("int") / 10.0).alias("lat"), (part(4).cast("int") / 10.0).alias("lon"))


@query(r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), r AS (SELECT doc_id, lang, len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] = p[2])) AS n,
len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) AS en, len(list_filter(w, lambda x: x IN ('der', 'die', 'und'))) AS de, len(list_filter(w, lambda x: x IN ('le', 'les', 'et'))) AS fr FROM w)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_repeated, CASE WHEN greatest(en, de, fr) = 0 THEN NULL WHEN en >= de AND en >= fr THEN 'en' WHEN de >= fr THEN 'de' ELSE 'fr' END AS looks_like FROM r""")
def text_checks(t) -> DataFrame:
    """Words that stand twice in a row, and the language that the small words look like."""
    w = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    n = F.size(F.filter(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b")), lambda p: p["a"] == p["b"]))
    count = lambda *words: F.size(F.filter("w", lambda x: x.isin(*words)))
    counted = w.select("doc_id", n.cast("long").alias("n_repeated"), count("the", "and", "of").alias("en"), count("der", "die", "und").alias("de"), count("le", "les", "et").alias("fr"))
    like = F.when(F.greatest("en", "de", "fr") == 0, None).when((F.col("en") >= F.col("de")) & (F.col("en") >= F.col("fr")), "en").when(F.col("de") >= F.col("fr"), "de").otherwise("fr")
    return counted.select("doc_id", "n_repeated", like.alias("looks_like"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), h AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: regexp_matches(x, '[0-9]')), true) AS hit FROM w),
s AS (SELECT doc_id, w, hit, greatest(1, least(hit - 12, len(w) - 24)) AS a FROM h WHERE hit > 0)
SELECT doc_id, w[hit] AS hit, array_to_string(w[a:a + 24], ' ') AS snippet FROM s""")
def snippet_around_hit(t) -> DataFrame:
    """At most 25 words with the first hit (a word with a digit) in their middle."""
    w = t.documents.select("doc_id", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("w"))
    hit = w.withColumn("hit", F.array_position(F.transform("w", lambda x: x.rlike("[0-9]")), True)).filter("hit > 0")
    start = F.greatest(F.lit(1), F.least(F.col("hit") - 12, F.size("w") - 24)).cast("int")
    return hit.select("doc_id", F.element_at("w", F.col("hit").cast("int")).alias("hit"), F.array_join(F.slice("w", start, F.lit(25)), " ").alias("snippet"))
