"""DuckDB SQL for the queries that SQL can express."""

#: CRC-32 of UTF-8 text: the 256 remainders of the reflected polynomial, then one step for each byte.
_CRC = """
crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, c)) AS t),
crcs AS MATERIALIZED (
  SELECT text, xor(list_reduce(list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                   lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS BIGINT) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc_table)
"""

#: The conversations with grafted starts, the nodes of their prefixes, and each node's ancestors.
_TRIE = """
crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, c)) AS t),
c AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, r, md5(t)) AS own FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_transform(range(length(d)), lambda i: CAST(ascii(substr(d, CAST(i + 1 AS BIGINT), 1)) AS BIGINT)), lambda a, b: xor(a // 256, crcs[CAST(xor(a % 256, b) AS BIGINT) + 1]), 4294967295), 4294967295) % 6 AS h
      FROM (SELECT conv_id, own, CAST(conv_id AS VARCHAR) AS d, t AS crcs FROM c, crc_table)),
b AS (SELECT h.conv_id, list_concat(coalesce(base.own, [])[1 : CAST(h AS BIGINT)], h.own[CAST(h + 1 AS BIGINT) :]) AS turns FROM h LEFT JOIN c base ON base.conv_id = h.conv_id - h.conv_id % 100),
p AS MATERIALIZED (SELECT conv_id, d, len(turns) AS n, md5(CAST(to_json(turns[1 : d]) AS VARCHAR)) AS node, CASE WHEN d > 0 THEN md5(CAST(to_json(turns[1 : d - 1]) AS VARCHAR)) END AS parent, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS points
                   FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
v AS MATERIALIZED (SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(points) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY d, node),
k AS MATERIALIZED (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
l AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children FROM v LEFT JOIN k USING (d, node)),
a AS (SELECT p.d, p.node, CAST(count(*) FILTER (l.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(l.saved) AS BIGINT) AS saved FROM l JOIN p ON p.conv_id = l.conv_id AND p.d <= l.d GROUP BY ALL)
"""
_CODED = lambda k: f"""a{k} AS MATERIALIZED (SELECT p.rid, p.part, arg_min(b.entry, b.far * 64 + b.entry) AS entry, min(b.far) AS far FROM p, LATERAL (SELECT e.entry, CAST(list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far FROM b{k} e WHERE e.part = p.part) b GROUP BY p.rid, p.part)"""
_BOOK = lambda k: f"""s{k} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p.part, a.entry, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM a{k} a JOIN p USING (rid, part)) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""  # noqa: E731

ORACLES = {
    "op1_sharding": f"""
WITH {_CRC.strip()},
r AS (SELECT doc_id, octet_length(encode(d.text)) + 1 AS size, crc, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || (octet_length(encode(d.text)) + 1) || ':' || crc) AS shuffle
      FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) d JOIN crcs USING (text)),
f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY shuffle, doc_id, size, crc) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, doc_id, size, crc) - 1 AS position, count(*) OVER () AS total FROM f),
s AS (SELECT *, position * 8 // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(position - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op4_decontamination": r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
g AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT rid, item, i, g.n FROM g JOIN p USING (n, gram)),
k AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN k USING (rid) LEFT JOIN m USING (rid)""",
    "op8_topk_search": """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 524288)) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.rid <> v.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op10_chat_format": """
WITH c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS turns FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, len(turns) AS n, turns, md5(CAST(turns AS VARCHAR)) AS whole FROM c),
p AS (SELECT DISTINCT i AS n, md5(CAST(turns[1:i] AS VARCHAR)) AS whole FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM c)),
m AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM h ANTI JOIN p USING (n, whole) GROUP BY n, whole),
o AS (SELECT conv_id, n, n_copies, turns, unnest(range(0, (n + 255) // 256)) AS part FROM m JOIN h USING (conv_id))
SELECT conv_id, CAST(part AS INTEGER) AS part, CAST(n AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
       array_to_string(list_transform(turns[part * 256 + 1 : part * 256 + 256], lambda x: '<|' || x.r || '|>' || chr(10) || x.t || chr(10) || '<|end|>' || chr(10)), '') AS text FROM o""",
    "op12_prefix_trie": f"""
WITH {_TRIE.strip()}
SELECT l.conv_id, l.d AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, a.n_leaves, a.saved AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM l JOIN a USING (d, node) LEFT JOIN v u ON u.d = l.d - 1 AND u.node = l.parent""",
    "op13_vector_codes": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 131072)) = 0),
w AS (SELECT (max(len(e)) + 15) // 16 AS step FROM v),
p AS MATERIALIZED (SELECT rid, part, list_transform(range(1, step + 1), lambda i: coalesce(e[CAST(part * step + i AS BIGINT)], 0)) AS x FROM v, w, range(16) r(part)),
b0 AS MATERIALIZED (SELECT part, rid AS entry, x FROM p WHERE rid < 64),
{_CODED(0)}, {_BOOK(0)}, {_CODED(1)}, {_BOOK(1)}, {_CODED(2)},
c AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY rid),
q AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), q""",
}
