"""DuckDB's SQL for the corpus operators that it can express: the same rows as their queries."""

from __future__ import annotations

import re

from heronry.llm.quality import BOILERPLATE_MAX_CHARS, MARKED_END, MARKS, NOTICE_PART, NOTICES, PROMPT_PART, PROMPTS, whole_words

WINDOW = 13


def _words(text: str) -> str:
    """Words as op1 takes them."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
items AS (SELECT row_number() OVER () AS k, coalesce(item_id::VARCHAR, 'null') AS item, {_words("text")} AS w FROM benchmark),
item_words AS (SELECT k, item, least({WINDOW}, len(w)) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM items),
item_windows AS (SELECT k, item, n, i, string_agg(a, ' ') OVER ahead AS g FROM item_words WINDOW ahead AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) QUALIFY count(*) OVER ahead = n),
sizes AS (SELECT DISTINCT n FROM item_words),
doc_words AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM docs),
doc_windows AS (SELECT r, n, p, string_agg(a, ' ') OVER ahead AS g FROM doc_words, sizes WINDOW ahead AS (PARTITION BY r, n ORDER BY p ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) QUALIFY count(*) OVER ahead = n),
met AS (SELECT r, k, item, n, p, i FROM doc_windows JOIN item_windows USING (n, g)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, n, p FROM met), unnest(range(p, p + n)) AS u(q) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r),
chained AS (SELECT *, p - row_number() OVER (PARTITION BY r, k, p - i ORDER BY p) AS island FROM met),
matches AS (SELECT r, item, min(p) - 1 AS place, count(*) + any_value(n) - 1 AS size FROM chained GROUP BY r, k, item, p - i, island),
longest AS (SELECT r, arg_max({{'item': item, 'place': place, 'size': size}}, (size, -place, item)) AS m FROM matches GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(m.size, 0)::BIGINT AS longest_match, m.place::BIGINT AS longest_at, m.item AS longest_item
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r) LEFT JOIN longest USING (r)
"""

_SPACE, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_N_WORDS = f"len(regexp_extract_all(line, '{_INK}+'))"
_MARKED = rf"[{MARKS}\p{{Thai}}\p{{Lao}}]"
_END = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), MARKED_END.replace("(?md)", "(?m)")).replace("'", "''")
_SHARE = "(length(line) - length(regexp_replace(lower(line), '{}', '', 'g'))) * {} >= length(line)"
_BOILERPLATE = f"({_SHARE.format(whole_words(NOTICES), NOTICE_PART)} OR {_SHARE.format(whole_words(PROMPTS), PROMPT_PART)})"

QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '{_INK}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_INK}')) AS lines FROM docs),
placed AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM worded),
ahead AS (SELECT r, p, a, lead(a) OVER (PARTITION BY r ORDER BY p) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY p) AS c FROM placed),
windows AS (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM ahead WHERE c IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT q) AS n FROM windows, unnest([p, p + 1, p + 2]) AS u(q) WHERE windows.n > 1 GROUP BY r),
paragraphs AS (SELECT r, unnest(regexp_split_to_array(t, '\n(?:[\x20\x09\x0B-\x0D]*\n)+')) AS para FROM worded),
flowing AS (SELECT r, unnest(string_split(para, chr(10))) AS line FROM paragraphs
  WHERE len(list_filter(string_split(para, chr(10)), lambda x: regexp_matches(x, '{_INK}'))) >= 2 AND regexp_matches(para, '{_MARKED}')
  AND len(regexp_extract_all(para, '{_END}')) * 2 <= len(list_filter(string_split(para, chr(10)), lambda x: regexp_matches(x, '{_INK}')))),
wrapped AS (SELECT DISTINCT r, line FROM flowing),
single AS (SELECT DISTINCT r, line FROM (SELECT r, unnest(lines) AS line FROM worded)),
judged AS (SELECT r, length(line) AS n,
  (len(regexp_extract_all(line, '[|»›·•]')) >= 2 AND len(regexp_extract_all(line, '[|»›·•]')) * 4 >= {_N_WORDS})
  OR (length(line) - length(translate(line, '#*$%&|<>', ''))) * 20 > length(line)
  OR (len(regexp_extract_all(line, '\\p{{Lu}}')) >= 20 AND len(regexp_extract_all(line, '\\p{{Lu}}')) * 10 > length(line) * 3)
  OR (length(line) <= {BOILERPLATE_MAX_CHARS} AND {_BOILERPLATE})
  OR (NOT regexp_matches(line, '{_MARKED}') AND {_N_WORDS} >= 12 AND NOT EXISTS (SELECT 1 FROM wrapped AS x WHERE x.r = single.r AND x.line = single.line)) AS bad FROM single),
good AS (SELECT r, sum(n) FILTER (NOT bad) AS chars FROM judged GROUP BY r),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0) AS good_chars, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS all_chars
  FROM worded LEFT JOIN repeated USING (r) LEFT JOIN good USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good_chars >= 0.5 * all_chars AS kept,
  CASE WHEN all_chars > 0 THEN round(1 - good_chars::DOUBLE / all_chars::DOUBLE, 6) ELSE 0.0::DOUBLE END AS line_loss FROM failed
"""

CHAT = """
WITH told AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS x FROM conversations GROUP BY conv_id),
parts AS (SELECT DISTINCT x[1:k] AS x FROM told, unnest(range(1, len(x))) AS u(k)),
whole AS (SELECT x, min(conv_id) AS conv_id, count(*) AS n_same FROM told GROUP BY x)
SELECT conv_id::BIGINT AS conv_id, len(x)::BIGINT AS n_turns, n_same::BIGINT AS n_same,
  array_to_string(list_transform(x, lambda e: '<|im_start|>' || replace(coalesce(e.r, ''), '<|', '< |') || chr(10) || replace(coalesce(e.t, ''), '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM whole ANTI JOIN parts USING (x)
"""



def _clusters(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Every assignment and every move as a relation of its own."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        "q AS MATERIALIZED (SELECT r, unnest(list_transform(e, lambda x: greatest(least(floor(256 * x), 134217728), -134217728)::BIGINT)) AS x, generate_subscripts(e, 1) AS i FROM kept)",
        f"first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null')), e) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN q USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, m.c AS c, m.d AS d FROM (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT q.r, c{n}.c, sum((q.x - c{n}.x) * (q.x - c{n}.x)) AS d FROM q JOIN c{n} USING (i) GROUP BY ALL) GROUP BY r))")
        if n < rounds:
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(y, x)::BIGINT AS x FROM c{n} LEFT JOIN (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM a{n} JOIN q USING (r) GROUP BY ALL) USING (c, i))")
    parts += [
        f"inside AS (SELECT c, sum(d) AS n FROM a{rounds} GROUP BY c)",
        f"named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)",
    ]
    most = "least({}, 9223372036854775807::HUGEINT)::BIGINT"
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, {most.format('n')} AS cluster_inertia, {most.format('(SELECT sum(n) FROM inside)')} AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN inside USING (c) JOIN named USING (c)"


CLUSTERS = _clusters()


def _features(rows: str) -> str:
    """(r, f): the words and the pairs of words of (r, w)."""
    return f"SELECT r, f FROM (SELECT r, a AS f FROM {rows} UNION ALL SELECT r, a || ' ' || lead(a) OVER (PARTITION BY r ORDER BY p) FROM {rows}) WHERE f IS NOT NULL"


#: crc32 bit by bit: a byte goes in, then eight shifts (-1) follow.
_STEPS = "flatten(list_transform(range(0, octet_length(encode(f))), lambda i: [('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_STEPS}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"

RESAMPLE = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents), items AS (SELECT row_number() OVER () AS r, {_words("text")} AS w FROM benchmark),
doc_words AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM docs), item_words AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM items),
doc_features AS MATERIALIZED ({_features("doc_words")}), item_features AS MATERIALIZED ({_features("item_words")}),
buckets AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT f FROM doc_features UNION SELECT f FROM item_features)),
source AS (SELECT bucket, count(*) AS n FROM doc_features JOIN buckets USING (f) GROUP BY bucket), target AS (SELECT bucket, count(*) AS n FROM item_features JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM doc_features)::DOUBLE AS s, (SELECT count(*) FROM item_features)::DOUBLE AS t),
gains AS (SELECT source.bucket, floor(1000 * ln((coalesce(target.n, 0) + 1)::DOUBLE * (s + 10000) / ((source.n + 1)::DOUBLE * (t + 10000))))::BIGINT AS gain FROM source LEFT JOIN target USING (bucket), totals),
weights AS (SELECT r, count(*) AS n, (sum(gain) - ((sum(gain) % count(*)) + count(*)) % count(*)) // count(*) AS weight FROM doc_features JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontamination": DECONTAMINATION, "op6_quality_rules": QUALITY, "op8_chat": CHAT, "op11_resample": RESAMPLE, "op13_clusters": CLUSTERS}
