"""Addresses, markup, text normalisation, extraction and replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import FOLD_FROM, FOLD_TO, TRACKING, canonical_url, fold, html_text
from heronry.plans.registry import query

_FOLDED = f"trim(regexp_replace(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://(www\.|m\.)?', '') AS bare FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_extract(bare, '^([^?]*)', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN {TRACKING})) AS k FROM b),
d AS (SELECT page_id, 'https://' || path || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS canonical FROM c)
SELECT canonical, min(page_id)::BIGINT AS first_page, count(*)::BIGINT AS n_pages FROM d GROUP BY canonical""")
def url_canonical(t) -> DataFrame:
    return t.pages.groupBy(canonical_url(F.col("url")).alias("canonical")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n_pages"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS s FROM a)
SELECT page_id, trim(regexp_replace(s, '[ \t\n\r]+', ' ', 'g')) AS shown FROM b""")
def html_text_of_pages(t) -> DataFrame:
    return t.pages.select("page_id", html_text(F.col("html")).alias("shown"))


@query(f"SELECT doc_id, sha256({_FOLDED}) AS folded_sha256, length({_FOLDED})::BIGINT AS n FROM documents")
def text_normalise(t) -> DataFrame:
    folded = t.documents.select("doc_id", fold(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.sha2("folded", 256).alias("folded_sha256"), F.char_length("folded").cast("long").alias("n"))


@query(f"""WITH f AS (SELECT doc_id, lang, sha256({_FOLDED}) AS h FROM documents)
SELECT lang, h, min(doc_id)::BIGINT AS original, count(*)::BIGINT - 1 AS n_replicas FROM f GROUP BY lang, h HAVING count(*) > 1""")
def replica_counts(t) -> DataFrame:
    hashed = t.documents.groupBy("lang", F.sha2(fold(F.col("text")), 256).alias("h"))
    return hashed.agg(F.min("doc_id").alias("original"), (F.count("*") - 1).alias("n_replicas")).filter("n_replicas > 0")


@query(f"""WITH f AS (SELECT source, sha256({_FOLDED}) AS h FROM documents)
SELECT h, count(DISTINCT source)::BIGINT AS n_sources, count(*)::BIGINT AS n_rows FROM f GROUP BY h HAVING count(DISTINCT source) >= 2""")
def two_source_admission(t) -> DataFrame:
    pairs = t.documents.groupBy(F.sha2(fold(F.col("text")), 256).alias("h"), "source").agg(F.count("*").alias("n"))
    return pairs.groupBy("h").agg(F.count("source").alias("n_sources"), F.sum("n").alias("n_rows")).filter("n_sources >= 2")


@query(f"SELECT doc_id, array_to_string({_WORDS}[1:25], ' ') AS snippet FROM documents")
def snippet_words(t) -> DataFrame:
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    return t.documents.select("doc_id", F.array_join(F.slice(words, 1, 25), " ").alias("snippet"))


@query("""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS k FROM documents)
SELECT doc_id, len(k)::BIGINT AS n_numbers, array_to_string(list_sort(list_distinct(k)), ',') AS numbers FROM n WHERE len(k) > 0""")
def number_and_unit_extract(t) -> DataFrame:
    found = t.documents.select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("k")).filter(F.size("k") > 0)
    return found.select("doc_id", F.size("k").cast("long").alias("n_numbers"), F.array_join(F.array_sort(F.array_distinct("k")), ",").alias("numbers"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+'))::BIGINT AS n_masked,
md5(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[mail]', 'g')) AS masked_md5 FROM documents""")
def mask_terms(t) -> DataFrame:
    mail = "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(mail)).cast("long").alias("n_masked"), F.md5(F.regexp_replace("text", mail, "[mail]").cast("binary")).alias("masked_md5"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS fingerprint FROM documents""")
def fingerprint_sha256(t) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "n_chars", "source")), 256).alias("fingerprint"))


@query(f"""WITH w AS (SELECT lang, unnest({_WORDS}) AS w FROM documents), c AS (SELECT lang, w, count(*)::BIGINT AS n FROM w WHERE regexp_matches(w, '^[A-Z][a-z]+$') GROUP BY lang, w)
SELECT lang, w AS token, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 20""")
def capitalised_tokens(t) -> DataFrame:
    words = t.documents.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("token")).filter(F.col("token").rlike("^[A-Z][a-z]+$"))
    counted = words.groupBy("lang", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "token")
    return counted.withColumn("k", F.row_number().over(w)).filter("k <= 20").select("lang", "token", "n")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, regexp_matches(line, '^[A-Za-z_]+ *[:=] *[^ ]') AS good FROM l WHERE trim(line) <> '')
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (good)::BIGINT AS n_parsed FROM p GROUP BY doc_id""")
def line_parser(t) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike("^[A-Za-z_]+ *[:=] *[^ ]")).alias("n_parsed"))


@query("""SELECT lang, CASE WHEN regexp_matches(lower(text), 'licen[sc]e|copyright') AND NOT regexp_matches(lower(text), 'password|secret') THEN 'admitted' WHEN regexp_matches(lower(text), 'password|secret') THEN 'excluded' ELSE 'other' END AS verdict, count(*)::BIGINT AS n FROM documents GROUP BY ALL""")
def vocabulary_admission(t) -> DataFrame:
    low = F.lower("text")
    excluded = low.rlike("password|secret")
    verdict = F.when(low.rlike("licen[sc]e|copyright") & ~excluded, "admitted").when(excluded, "excluded").otherwise("other")
    return t.documents.groupBy("lang", verdict.alias("verdict")).agg(F.count("*").alias("n"))
