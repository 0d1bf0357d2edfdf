"""Expected rows as SQL (DuckDB) for the operators that SQL can express.

The others are compared with brute-force versions in the tests.
"""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_QUALITY = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n FROM twice GROUP BY 1
), counted AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM texts LEFT JOIN repeats USING (doc_id)
), judged AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 5 * length(t) OR 100 * n_dup_lines > 30 * len(lines)
            OR 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 50 * length(t)
            OR 100 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 30 * length(t)) AS kept
FROM judged"""

_JACCARD = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY 1, 2, m.n, n.n HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(32 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|'))
             + len(regexp_extract_all(text, '<\\*\|'))) AS chars
  FROM turns GROUP BY 1
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined"""

_WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
  SELECT page_id, n, max(page_id) OVER (PARTITION BY h) AS original, array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS digest
  FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM digests"""

_DECONTAMINATION = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents
), items AS (
  SELECT item_id, w, least(10, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark) WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), windows AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM texts, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
), hits AS (
  SELECT DISTINCT doc_id, i, k, item_id FROM windows JOIN item_windows USING (k, g)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words h USING (doc_id) LEFT JOIN found f USING (doc_id)"""

_FIM = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), numbers AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4
  FROM drawn
), formed AS (
  SELECT doc_id, t, n, least(h1, h2) AS a, greatest(h1, h2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, '<P>' || substr(t, 1, a) AS prefix, '<M>' || substr(t, a + 1, b - a) AS middle, '<S>' || substr(t, b + 1, n - b) AS suffix
  FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END)
         AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


def _assignment(centroids: str) -> str:
    """Every vector with its nearest centroid and the squared distance."""
    return f"""
  SELECT id, min(d) AS d, arg_min(c, 8 * d + c) AS c
  FROM (SELECT id, c, sum((x.x - y.x) * (x.x - y.x)) AS d FROM flat x JOIN {centroids} y USING (i) GROUP BY id, c)
  GROUP BY id"""


def _clusters(rounds: int) -> str:
    """The rounds of moving centroids, one after the other."""
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED ({_assignment(f"c{r - 1}")}
), c{r} AS MATERIALIZED (
  SELECT c, i, coalesce(m, x) AS x
  FROM c{r - 1} LEFT JOIN (
    SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM a{r} JOIN flat USING (id) GROUP BY c, i) USING (c, i)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), flat AS MATERIALIZED (
  SELECT id, i, v[i] AS x FROM (SELECT id, v, unnest(range(1, 65)) AS i FROM kept)
), first AS (
  SELECT id, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c FROM kept
), c0 AS MATERIALIZED (
  SELECT c, i, x FROM first JOIN flat USING (id) WHERE c < 8
), {", ".join(steps)}, placed AS MATERIALIZED ({_assignment(f"c{rounds}")}
), digests AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM placed JOIN kept USING (id) JOIN digests USING (c)"""


ORACLE = {
    "op2_quality_rules": _QUALITY,
    "op3_ngram_jaccard_join": _JACCARD,
    "op4_chat_formatting": _CHAT,
    "op5_warc": _WARC,
    "op8_benchmark_decontamination": _DECONTAMINATION,
    "op11_fill_in_middle": _FIM,
    "op13_centroid_clustering": _clusters(10),
}
