"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

GAP = r"[ \x09-\x0D]+"

OP5 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), b AS (
  SELECT doc_id, p, substring(h, 2 * p + 1, 2) AS x, CASE WHEN p + 50 <= n THEN md5_number(substring(h, 2 * p + 1, 100)) END AS s FROM d, range(0, n) AS r(p)
), f AS (
  SELECT doc_id, p, x, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS starts FROM b
), g AS (
  SELECT doc_id, p, x, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM g
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans,
         coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM s GROUP BY 1
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{GAP}') IF x <> ''] AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^ \\x09-\\x0D]')] AS l
  FROM documents
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM d, range(1, len(w) - 1) AS r(i)
), rep AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM tri, range(0, 3) AS r(j) WHERE c >= 2 GROUP BY 1
), m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[ \\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > 5 * n_words OR 10 * n_dup_lines > 3 * n_lines AS other FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR other) AS k FROM f GROUP BY 1
), p AS (
  SELECT avg(k / n) AS mean, var_pop(k / n) AS v FROM h
), q AS (
  SELECT mean, CASE WHEN v > 0 AND mean > 0 AND mean < 1 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS weight FROM p
), r AS (
  SELECT source, (k + mean * weight) / (n + weight) AS rate FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

OP8 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}') IF x <> ''] AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM d, range(1, greatest(len(w) - 3, 2)) AS r(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
)
SELECT reach.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY 1
"""

OP9 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.first IS NULL OR g.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{GAP}') IF x <> ''] AS w FROM documents
), v AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w[i:i + 19] ORDER BY doc_id, i) AS nth FROM d, range(1, len(w) - 18) AS r(i) WHERE len(w) >= 20
), g AS (
  SELECT DISTINCT doc_id, i + j AS p FROM v, range(0, 20) AS r(j) WHERE nth > 1
), x AS (
  SELECT d.doc_id, r.p, d.w[r.p] AS word, g.p IS NOT NULL AS gone
  FROM d CROSS JOIN range(1, len(d.w) + 1) AS r(p) LEFT JOIN g ON g.doc_id = d.doc_id AND g.p = r.p
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM x GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_CRC_STEP = "xor((c >> 4), [{}][(c & 15) + 1])".format(", ".join(str(x) for x in (0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C)))
#: crc32 of the digits of doc_id: two steps of four bits each.
CRC_OF_ID = (
    "xor(4294967295::BIGINT, list_reduce(list_transform(list_prepend(-1::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda x: CASE WHEN x < 0 THEN 4294967295::BIGINT ELSE x END), "
    "lambda s, x: list_reduce([xor(s, x), 0, 0], lambda c, k: " + _CRC_STEP + ")))"
)

OP11 = f"""
WITH e AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{GAP}') IF x <> ''] AS w, {CRC_OF_ID} AS h FROM documents
), f AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM e
), p AS (
  SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS q FROM f
), d AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END]) ELSE w END AS w FROM p
), x AS (
  SELECT doc_id, n, r.i, d.w[r.i + 1] AS word FROM d, range(0, n) AS r(i)
), m AS (
  SELECT s.doc_id, s.i, t.i - s.i AS p FROM x s JOIN x t ON s.doc_id = t.doc_id AND s.word = t.word AND t.i > s.i AND 3 * (t.i - s.i) <= s.n
), l AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM m) GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(24, 3 * p)
), u AS (
  SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(p)::BIGINT AS period FROM l GROUP BY 1, 2, 3
), z AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY 1
), v AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length * 3600000000 // period DESC, start, period) AS nth FROM u
), g AS (
  SELECT DISTINCT doc_id, i FROM u, range(start + period, start + length) AS r(i)
), k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY 1
)
SELECT d.doc_id, coalesce(z.n_runs, 0)::BIGINT AS n_runs, v.start, v.length, v.period, 1000 * v.length // v.period AS exponent_milli,
       sha256(coalesce(z.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN v ON v.doc_id = d.doc_id AND v.nth = 1 LEFT JOIN k ON k.doc_id = d.doc_id
"""
