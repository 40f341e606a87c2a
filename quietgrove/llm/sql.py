"""The same results in DuckDB's SQL, where SQL can express them."""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
filled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, coalesce(query, '') AS query
  FROM parts),
tails AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> ''
      AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') AS tail
  FROM filled),
keyed AS (
  SELECT *, CASE WHEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') <> '' THEN
      regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(path, '/+$', '') || CASE WHEN tail <> '' THEN '?' || tail ELSE '' END END AS key
  FROM tails),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM keyed),
listed AS (
  SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL AND regexp_matches(host, '(adult|casino|pills)'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       l.key IS NOT NULL AS listed
FROM ruled LEFT JOIN listed l ON ruled.key = l.key
"""

QUALITY_RULES = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words
  FROM documents),
spots AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM base WHERE len(words) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM spots)
  WHERE n > 1),
steps AS (
  SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5), 5) AS step
  FROM twice),
repeats AS (SELECT doc_id, sum(step) AS n FROM steps GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM base),
measured AS (
  SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS lettered
  FROM base b JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * n_lines
            OR 10 * lettered < 7 * n_words) AS kept
FROM failed
"""

CHAT_FORMATTING = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, len(regexp_extract_all(text, '\pL+|\pN|[^\s\v\pL\pN]')) + 6 AS tokens,
         21 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
         + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + 1 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx
  FROM rows_),
placed AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx) AS BIGINT) - tokens AS start,
         greatest(1, CAST(floor((768 - coalesce(max(CASE WHEN role = 'system' THEN tokens END)
           OVER (PARTITION BY conv_id), 0)) / 2) AS BIGINT)) AS half
  FROM sized),
flagged AS (
  SELECT *, coalesce(tokens > half OR lag(tokens > half) OVER w OR lag(start // half) OVER w <> start // half,
                     true) AS opens
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
spans AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS win
  FROM flagged),
context AS (
  SELECT f.conv_id, f.win, coalesce(sum(t.chars), 0) AS chars
  FROM spans f JOIN spans t ON f.conv_id = t.conv_id AND t.idx < f.idx AND f.opens
   AND ((t.role <> 'system' AND t.start >= f.start - 256)
        OR (t.role = 'system' AND t.idx = (SELECT max(s.idx) FROM spans s
            WHERE s.conv_id = f.conv_id AND s.role = 'system' AND s.idx < f.idx)))
  GROUP BY 1, 2),
repeated AS (SELECT conv_id, sum(chars) AS chars FROM context GROUP BY 1)
SELECT s.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '')) AS loss_sha256,
       CAST(sum(s.chars) + coalesce(max(r.chars), 0) AS BIGINT) AS formatted_chars
FROM spans s LEFT JOIN repeated r ON s.conv_id = r.conv_id
GROUP BY s.conv_id
"""

HARD_NEGATIVES = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
rows AS (SELECT DISTINCT * FROM usable),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
good AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT g.anchor_id, g.positive_id,
       CAST(row_number() OVER (PARTITION BY g.anchor_id, g.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, g.positive_score, s.score AS negative_score
FROM good g JOIN scored s ON g.anchor_id = s.anchor_id AND NOT s.alike
 AND 30 * g.positive_score <= 100 * s.score AND 100 * s.score <= 90 * g.positive_score
QUALIFY rank <= 10
"""

WARC = r"""
WITH hashed AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
digested AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((CAST('0x' || substr(hex, i * 5 + 1, 5) AS INTEGER) >> s) & 31) + 1, 1)), '')), '') AS payload_digest
  FROM hashed),
placed AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS head
  FROM digested WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN head END AS refers_to
FROM placed
"""

ORACLE = {"op1_url_filter": URL_FILTER, "op2_quality_rules": QUALITY_RULES,
          "op9_chat_formatting": CHAT_FORMATTING, "op11_hard_negatives": HARD_NEGATIVES,
          "op13_warc": WARC}
