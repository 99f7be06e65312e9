"""DuckDB SQL for the rows of the queries that SQL can express."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio,
         ((SELECT sum(source_size) FROM s)
          - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM s),
t AS (
  SELECT source, source_size,
         least(cap, (SELECT lv FROM l WHERE lv * w <= cap ORDER BY ratio, encode(source) NULLS LAST LIMIT 1) * w) AS target
  FROM l),
c AS (
  SELECT d.*, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - d.size AS before_,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END::BIGINT AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, floor(target)::BIGINT - whole * source_size - before_)))::BIGINT AS taken
FROM c
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(17 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
d AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.x = p.a),
c AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, c.component_id FROM d JOIN c USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest AS d, max(page_id) AS top, count(*) AS copies FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN copies > 1 AND payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN copies > 1 AND payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.d
"""

# components are summed in their order, as the operator does
VPTREE = r"""
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x * x)), lambda a, b: a + b)) AS norm FROM e),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

ORACLE = {"op4_vptree": VPTREE, "op5_warc": WARC, "op2_mix": MIX, "op9_ngram_join": NGRAM_JOIN, "op10_chat": CHAT}
