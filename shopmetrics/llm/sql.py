"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') AS g FROM starts
), firsts AS (
  SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p
  FROM windows JOIN firsts USING (g) WHERE first_doc < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE g.p IS NULL) AS kept,
    count(g.p) AS n
  FROM words LEFT JOIN (SELECT doc_id AS own, p FROM gone) g
    ON words.doc_id = g.own AND words.p = g.p
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * both_n >= 90 * (x.n + y.n - both_n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles,
  min(other) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
  SELECT page_id, octet_length(payload) AS size, sha1(payload) AS hex,
    max(page_id) OVER (PARTITION BY sha1(payload)) AS largest
  FROM p
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)
      >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM h
"""

CHAT_SNAPSHOTS = """
WITH t AS (
  SELECT conv_id, turn, role, text,
    coalesce(CAST(strlen(role) AS VARCHAR), '-') || ':' || coalesce(role, '')
      || coalesce(CAST(strlen(text) AS VARCHAR), '-') || ':' || coalesce(text, '') AS one,
    '<|begin|>' || CASE WHEN role IS NULL THEN 'unknown' ELSE replace(role, '<|', '<') END
      || chr(10) || replace(coalesce(text, ''), '<|', '<') || '<|end|>' || chr(10) AS shown
  FROM conversations WHERE conv_id IS NOT NULL
), prefixes AS (
  SELECT conv_id, md5(string_agg(one, '|') OVER w) AS prefix, row_number() OVER w AS n_turns,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
    text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), logged AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies
  FROM prefixes WHERE n_turns = total GROUP BY prefix
), kept AS (
  SELECT * FROM logged
  WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE n_turns < total)
), snapshots AS (
  SELECT p.conv_id, sum(l.n_copies) AS n_snapshots
  FROM prefixes p JOIN kept k ON k.conv_id = p.conv_id JOIN logged l ON l.prefix = p.prefix
  WHERE p.n_turns < p.total GROUP BY p.conv_id
), rendered AS (
  SELECT conv_id, string_agg(shown, '' ORDER BY turn NULLS FIRST, role NULLS FIRST,
    text NULLS FIRST) AS rendered
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
  CAST(coalesce(n_snapshots, 0) AS BIGINT) AS n_snapshots, rendered
FROM kept LEFT JOIN snapshots USING (conv_id) JOIN rendered USING (conv_id)
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# CRC-32 byte by byte from a table of 256 entries; each distinct word once.
IMPORTANCE_RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))
), all_texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents
  UNION ALL SELECT 'b', NULL, text FROM benchmark
), worded AS (
  SELECT side, doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM all_texts
), words AS (
  SELECT side, r, unnest(w) AS word FROM worded
), coded AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(CAST(length(h) // 2 AS BIGINT)),
      lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, list_extract(t, xor(c & 255, x) + 1))), 4294967295) % 10000 AS bucket
  FROM coded, crc_table
), features AS (
  SELECT side, r, bucket FROM words JOIN hashed USING (word)
), counts AS (
  SELECT bucket, CAST(count(*) FILTER (WHERE side = 'd') AS DOUBLE) AS s,
    CAST(count(*) FILTER (WHERE side = 'b') AS DOUBLE) AS t
  FROM features GROUP BY bucket
), sums AS (
  SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT)
    AS gain
  FROM counts, sums
), weights AS (
  SELECT r, sum(gain) AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM worded LEFT JOIN weights USING (r) WHERE side = 'd'
), rated AS (
  SELECT doc_id, r, n_features, weight,
    weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM scored
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features DESC) AS place,
    count(*) OVER () AS n
  FROM rated WHERE n_features >= 20 AND score IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CAST(place AS BIGINT) AS rank
FROM rated LEFT JOIN (SELECT r, place FROM placed WHERE place <= 10 * n // 100) USING (r)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, len(g) AS size, array_to_string(g, ' ') AS g FROM (
    SELECT item, list_slice(w, s, s + 9) AS g
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0))
), sizes AS (
  SELECT DISTINCT size FROM windows
), grams AS (
  SELECT r, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), found AS (
  SELECT r, s, grams.size, item FROM grams JOIN windows USING (g)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM found)
  GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

QUERIES = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_jaccard_join": JACCARD_JOIN,
    "op5_warc": WARC,
    "op9_chat_snapshots": CHAT_SNAPSHOTS,
    "op10_ball_tree": EXACT_TOP_K,
    "op12_importance_resampling": IMPORTANCE_RESAMPLING,
    "op13_decontamination": DECONTAMINATION,
}
