"""DuckDB SQL for the queries that SQL can express."""

#: White space of the contracts, for DuckDB's trim.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.holder IS NULL OR s.holder = k.doc_id AS keep
  FROM keyed k LEFT JOIN shared s ON k.key = s.key),
texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
  FROM judged GROUP BY doc_id),
islands AS (
  SELECT doc_id, pos, keep, pos - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS island FROM judged),
runs AS (
  SELECT doc_id, keep, min(pos) AS first, count(*) AS n FROM islands GROUP BY doc_id, keep, island),
bitmaps AS (
  SELECT doc_id, CASE WHEN arg_min(keep, first) THEN '' ELSE '0,' END || string_agg(n::VARCHAR, ',' ORDER BY first) || CASE WHEN arg_max(keep, first) THEN '' ELSE ',0' END AS keep_runs
  FROM runs GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, kept_sha256, keep_runs FROM texts JOIN bitmaps USING (doc_id)
"""

_OP7_BASE = r"""
docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word_rows AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM word_rows WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM counted, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id),
line_rows AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line_rows WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, source, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN dup_lines USING (doc_id)),
failing AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failing GROUP BY source),
moments AS (
  SELECT sum(f) / sum(n) AS mean, avg(f / n * (f / n)) - avg(f / n) ** 2 - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * avg(1.0 / n) AS variance FROM hosts),
prior AS (
  SELECT mean, CASE WHEN variance > 0 THEN least(greatest(mean * (1 - mean) / variance - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM moments),
verdicts AS (
  SELECT source, (f + mean * weight) / (n + weight) <= 0.5 AS host_ok FROM hosts, prior)
"""

OP7 = f"""
WITH {_OP7_BASE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM failing f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""
