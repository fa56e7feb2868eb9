"""DuckDB counterparts of the queries that SQL can express."""

OP6 = r"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS text FROM conversations
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS place FROM named
), people AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM named WHERE speaker NOT IN ('', 'system')
), seen AS (
  SELECT t.*, p.participant, t.place // 512 AS chunk, t.speaker = p.participant AS own,
    '<|im_start|>' || CASE WHEN t.speaker = p.participant THEN 'assistant' WHEN t.speaker = 'system' THEN 'system'
      WHEN t.speaker = '' THEN 'user' ELSE 'user name=' || t.speaker END || chr(10) AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), sized AS (
  SELECT *, length(head) + length(text) + length('<|im_end|>') + 1 AS size FROM seen
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, participant, chunk ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM sized
), chunks AS (
  SELECT conv_id, participant, chunk, count(*) AS n_turns, count(*) FILTER (own) AS n_own, sum(size) AS n_chars,
    sha256(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY place)) AS text_sha256,
    coalesce(string_agg(CAST(CAST(begins + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + size AS BIGINT) AS VARCHAR), ','
      ORDER BY place) FILTER (own), '') AS masks
  FROM placed GROUP BY ALL
)
SELECT conv_id, participant, CAST(chunk AS BIGINT) AS chunk,
  CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, participant ORDER BY chunk
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  n_turns, n_own, CAST(n_chars AS BIGINT) AS n_chars, text_sha256, masks
FROM chunks
"""

OP12 = r"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8
), lookup AS (
  SELECT list(v ORDER BY i) AS step FROM crc WHERE k = 8
), words AS (
  SELECT 0 AS target, row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT target, n, unnest(w) AS feature FROM words
  UNION ALL
  SELECT target, n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), counted AS (
  SELECT target, n, feature, count(*) AS times FROM features GROUP BY ALL
), bytes AS (
  SELECT feature, list_transform(regexp_extract_all(hex(encode(feature)), '..'),
    lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM (SELECT DISTINCT feature FROM counted)
), hashed AS (
  SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM bytes, lookup
), placed AS (
  SELECT target, n, bucket, times FROM counted JOIN hashed USING (feature)
), buckets AS (
  SELECT j AS bucket, coalesce(sum(times) FILTER (target = 0), 0) AS s, coalesce(sum(times) FILTER (target = 1), 0) AS t
  FROM range(10000) r(j) LEFT JOIN placed ON bucket = j GROUP BY j
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
    / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM buckets
), weighed AS (
  SELECT n, sum(times * gain) AS total, sum(times) AS n_features FROM placed JOIN gained USING (bucket)
  WHERE target = 0 GROUP BY n
), scored AS (
  SELECT doc_id, len(w) >= 20 AS eligible, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce(floor(CAST(total AS DOUBLE) / n_features), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM words LEFT JOIN weighed USING (n) WHERE words.target = 0
), ranked AS (
  SELECT *, weight + noise AS score,
    row_number() OVER (PARTITION BY eligible ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS place,
    count(*) FILTER (eligible) OVER () AS n_eligible FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n_eligible // 100 THEN place END AS rank
FROM ranked
"""

SQL: dict[str, str] = {"op6_perspective_rotation": OP6, "op12_importance_resampling": OP12}
