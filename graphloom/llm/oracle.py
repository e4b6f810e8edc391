"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from graphloom.llm.rules import STOP_WORDS, THRESHOLDS


def _limits() -> str:
    parts = []
    for name, least, most in THRESHOLDS:
        parts += [f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None)
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP9 = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT rid, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), grams AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM cut)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), measured AS (
  SELECT c.*, len(words) AS n_words, coalesce(r.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•·]'))) AS n_bullet,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
         len(list_intersect(list_distinct(regexp_split_to_array(lower(t), '[^\p{{L}}]+')), [{_STOP}])) AS stop_words
  FROM cut c LEFT JOIN repeats r USING (rid)
), rated AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN (length(t) - length(replace(t, '!', ''))) / n_words ELSE 0 END AS shout_ratio,
         CASE WHEN n_words > 0 THEN (length(t) - length(replace(t, '|', ''))) / n_words ELSE 0 END AS bar_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0 END AS bullet_line_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_line_ratio,
         (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed
  FROM measured
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       (NOT base_failed AND {_limits()}) AS kept
FROM rated
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN d.page_id IS DISTINCT FROM f.first AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to, true AS intact
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND d.payload_bytes >= 100
"""

OP2 = """
WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'message' END AS kind FROM conversations),
n AS (SELECT *, CASE kind WHEN 'call' THEN 'c' || CAST(turn AS VARCHAR) WHEN 'result' THEN 'c' || CAST(turn - 1 AS VARCHAR) END AS call_id FROM m),
l AS (SELECT n.*, kind = 'result' AND EXISTS (SELECT 1 FROM n c WHERE c.kind = 'call' AND c.conv_id = n.conv_id AND c.call_id = n.call_id) AS linked FROM n),
j AS (SELECT *, CASE kind WHEN 'call' THEN '{"role":"assistant","tool_call":{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || CAST(turn AS VARCHAR) || '},"id":"' || call_id || '","name":"say"}}'
  WHEN 'result' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"' || call_id || '"}' ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}' END AS json FROM l)
SELECT conv_id, turn, 0 AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN linked THEN 1 ELSE 0 END, json) - 1 AS position, kind, call_id, CASE WHEN kind = 'call' OR linked THEN 'say' END AS name, linked,
       kind <> 'result' OR linked AS valid, CASE WHEN kind = 'result' AND NOT linked THEN 'no such call' ELSE '' END AS error, json FROM j
"""

OP6 = r"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT rid, array_to_string(w, ' ') AS g FROM base WHERE len(w) BETWEEN 1 AND 2 UNION SELECT rid, array_to_string(w[i:i + 2], ' ') FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base WHERE len(w) >= 3)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT rid AS a, rid AS b FROM base UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT x.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, (SELECT min(y.doc_id) FROM reach r JOIN base y ON y.rid = r.b WHERE r.a = x.rid) AS component_id FROM base x LEFT JOIN sizes s ON s.rid = x.rid
"""

OP10 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT rid, vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
ok AS (SELECT * FROM u WHERE len > 0),
linked AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.9),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
comp AS (SELECT r.a, min(y.vec_id) AS c FROM reach r JOIN v y ON y.rid = r.b GROUP BY r.a)
SELECT v.vec_id, (SELECT count(*) FROM linked l WHERE l.a = v.rid) AS n_links, comp.c AS component_id, v.vec_id IS NOT DISTINCT FROM comp.c AS kept FROM v JOIN comp ON comp.a = v.rid
"""

ORACLE_SQL = {"op1_warc_revisits": OP1, "op2_tool_calls": OP2, "op6_ngram_jaccard": OP6, "op9_quality_rules": OP9, "op10_grid_order_join": OP10}
