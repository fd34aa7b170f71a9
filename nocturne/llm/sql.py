"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from nocturne.llm.quality_rules import BASE_RULES, RULES, STOP_WORDS

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), r AS (
  SELECT t.*, p.perspective, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
      ELSE 'user name=' || translate(replace(speaker, '<|', '< |'), chr(13) || chr(10), '  ') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, length(text) + 10 AS body,
    coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_
  FROM r
)
SELECT conv_id, perspective, count(*) AS n_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, speaker, text) AS text,
  coalesce(string_agg(CAST(CAST(begin_ AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin_ + body AS BIGINT) AS VARCHAR), ';' ORDER BY begin_)
    FILTER (WHERE own), '') AS mask,
  CAST(coalesce(sum(body) FILTER (WHERE own), 0) AS BIGINT) AS masked_chars
FROM s GROUP BY conv_id, perspective
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS k FROM starts
), least_ AS (
  SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT win.doc_id, win.i + o AS i FROM win JOIN least_ USING (k), range(0, 50) r(o) WHERE win.doc_id > m
), lost AS (
  SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

OP8 = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c >= 2
), cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM again, range(3) q(o) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN (STOPS))) AS stops, len(lines) AS n_lines,
    len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots
  FROM d LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    coalesce(n_repeat_words / nullif(n_words, 0), 0e0) AS repeat_word_ratio, coalesce(word_chars / nullif(n_words, 0), 0e0) AS mean_word_length,
    coalesce(n_symbols / nullif(n_words, 0), 0e0) AS symbol_word_ratio, coalesce(stops / nullif(n_words, 0), 0e0) AS stop_word_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0e0) AS dup_line_ratio, coalesce(bullets / nullif(n_lines, 0), 0e0) AS bullet_line_ratio,
    coalesce(dots / nullif(n_lines, 0), 0e0) AS ellipsis_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
)
SELECT *, NOT base_failed AND VERDICT AS kept FROM r
""".replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))).replace(
    "VERDICT",
    " AND ".join(f"{c} {op} {x!r}" for c, low, high in RULES if c not in BASE_RULES for op, x in ((">=", low), ("<=", high)) if x is not None),
)

OP9 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS original FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM f
"""

ORACLES: dict[str, str] = {"op2_chat": OP2, "op4_substring": OP4, "op7_quality": OP7, "op8_exact_dedup": OP8, "op9_warc": OP9}
