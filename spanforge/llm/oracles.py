"""SQL for the queries that SQL can express, over the same tables (doc_id and vec_id name one row each)."""

from __future__ import annotations

from spanforge.llm.mixing import MAX_REPEAT, RUN_ROWS, SEED

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _hash32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


#: Water-filled targets, then copies from integer crossings of the running expected copies.
MIX = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0) AS size FROM documents),
s AS (SELECT source, count(*) AS n_rows, sum(size)::HUGEINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, {MAX_REPEAT} * source_size AS cap, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(weight) OVER (ORDER BY cap * (6 // weight), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM w),
c AS (SELECT *, cap * weights_left <= weight * (total - caps_before) AS capped FROM f),
l AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS caps, coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 0) AS weights FROM c),
t AS (SELECT source, n_rows, source_size, (CASE WHEN capped THEN cap ELSE weight * (total - caps) END)::HUGEINT AS num, (CASE WHEN capped THEN 1 ELSE weights END)::HUGEINT AS den,
  greatest(1, (n_rows + rr - 1) // rr) AS runs FROM l, (SELECT greatest({RUN_ROWS}, floor(sqrt(count(*)))::BIGINT) AS rr FROM d)),
h AS (SELECT d.doc_id, d.source, d.size, t.source_size, num, den, {_hash32(f"'{SEED}|' || coalesce(doc_id::VARCHAR, '')")} % runs AS run,
  {_hash32(f"'{SEED}|offset|' || coalesce('s' || d.source, 'n')")} AS shift FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run, CASE WHEN run % 2 = 0 THEN size ELSE -size END, doc_id NULLS FIRST)::HUGEINT AS upto FROM h),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (upto * num * 4294967296 + shift * den * source_size) // (den * source_size * 4294967296)
  - ((upto - 1) * num * 4294967296 + shift * den * source_size) // (den * source_size * 4294967296) END AS copies FROM n)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, num::DOUBLE / den::DOUBLE AS target, (copies * size)::BIGINT AS taken FROM k"""

#: All pairs in double precision; every node takes the smallest id that reaches it.
EMBEDDING = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY ALL), n AS (SELECT a, count(*) AS n FROM p GROUP BY ALL)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""

#: Shingle sets joined on shared shingles.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS token FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN c ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: Every 200-byte string by its digest; texts as hexadecimal, two digits a byte.
REPEATS = """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS k FROM t WHERE len(h) >= 400),
g AS MATERIALIZED (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 400)) AS m FROM k),
c AS (SELECT doc_id, k FROM g SEMI JOIN (SELECT m FROM g GROUP BY m HAVING count(*) > 1) USING (m)),
o AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM c),
i AS (SELECT doc_id, k, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM o),
s AS (SELECT doc_id, span, min(k) AS lo, max(k) + 200 AS hi FROM i GROUP BY ALL),
u AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM s),
x AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last,
  string_agg(substr(h, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS front FROM u JOIN t USING (doc_id) GROUP BY ALL)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM t LEFT JOIN x USING (doc_id)"""

#: Rows in order of (checksum, id), cut where the middle byte of a row passes an equal share; the
#: checksum is folded byte by byte over its table.
SHARD = """
WITH c AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS MATERIALIZED (SELECT doc_id, (len(h) // 2)::BIGINT + 16 AS size, xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM t, c),
r AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w AS nth FROM d
  WINDOW w AS (ORDER BY text_crc32, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, least(39, (40 * (2 * upto - size)) // (2 * total))::INT AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s"""

#: Equal payloads by themselves; the digest's hexadecimal in groups of forty bits, eight digits of base 32 each.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, html, first, sha1(html) AS hex FROM p JOIN f USING (html))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || substr(hex, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31) + 1)::INT]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

ORACLE_SQL = {"op2_mix": MIX, "op3_embedding": EMBEDDING, "op5_jaccard": JACCARD, "op6_suffix_dedup": REPEATS, "op10_shard": SHARD, "op12_warc": WARC}
