"""DuckDB SQL for those queries that SQL can express over whole tables."""

from __future__ import annotations

OP3 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

_BASE32 = "".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {k}) & 31), 1){' || ' if k else ''}" for k in (15, 10, 5, 0))

OP1 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, sha256(body) AS k FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda j: list_transform([CAST('0x' || substr(hex, CAST(5 * j + 1 AS INT), 5) AS INT)], lambda v: {_BASE32})[1]), '') AS payload_digest FROM h),
f AS (SELECT k, min(page_id) AS first FROM h GROUP BY k)
SELECT b.page_id, b.payload_bytes, b.payload_digest,
  CASE WHEN b.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM b JOIN f USING (k)
"""

OP2 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT r, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.95),
c AS (SELECT a AS node, a AS seen FROM l UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(m.component_id, vec_id) AS component_id, vec_id = coalesce(m.component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.node = vec_id
"""


def _key(*parts: str) -> str:
    """The mixing operator's 60-bit md5 number of the parts."""
    return f"CAST('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 15) AS BIGINT)"


def _round(k: int) -> str:
    """One round of the partial pass: open documents that fit what is short, in block and priority order, until the next doesn't."""
    return f"""
f{k} AS (SELECT e.key, block, prio, size, short FROM e JOIN h{k} h ON h.key = e.key JOIN s ON s.key = e.key WHERE size > 0 AND size <= short AND {'short * 1000 > target AND ' if k else ''} NOT EXISTS (FROM g{k} WHERE g{k}.prio = e.prio AND g{k}.key = e.key)),
w{k} AS (SELECT key, prio, size, short, sum(size) OVER (PARTITION BY key ORDER BY {_key("'mix'", "'block'", "key", "CAST(block AS VARCHAR)")}, block, prio ROWS UNBOUNDED PRECEDING) AS upto FROM f{k}),
t{k} AS (SELECT key, prio, size FROM w{k} WHERE upto <= short),
g{k + 1} AS (SELECT key, prio FROM g{k} UNION ALL SELECT key, prio FROM t{k}),
h{k + 1} AS (SELECT h.key, short - coalesce(got, 0) AS short FROM h{k} h LEFT JOIN (SELECT key, sum(size) AS got FROM t{k} GROUP BY key) x ON x.key = h.key),"""


OP10 = f"""
WITH r AS (SELECT doc_id, coalesce('0' || source, '1') AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS who, md5(coalesce(text, '')) AS body FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key, who, body) - 1 AS number FROM r),
d AS (SELECT doc_id, key, size, {_key("'mix'", "who", "key", "body", "CAST(number AS VARCHAR)")} AS prio FROM n),
p AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS w, sum(source_size) OVER () AS total FROM p),
x AS (SELECT *, 3 * source_size * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) <= (total - coalesce(sum(3 * source_size) OVER b, 0)) * w AS capped FROM w WINDOW b AS (ORDER BY source_size * 6 / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT key, source_size, CASE WHEN source_size = 0 THEN 0 WHEN capped THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST(total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM x),
s AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / greatest(source_size, 1)) AS INT), 3) END AS passes FROM t),
z AS (SELECT greatest(6, least(18, 4 + greatest(2, least(18, CASE WHEN z = 0 THEN 0 ELSE length(bin(z)) END)))) AS bits FROM (SELECT CAST(sum(source_size) // 4000000 AS BIGINT) AS z FROM p)),
e AS (SELECT d.*, CAST(prio >> (60 - bits) AS BIGINT) AS block FROM d, z),
g0 AS (SELECT key, prio FROM e WHERE false), h0 AS (SELECT key, target - passes * source_size AS short FROM s),{"".join(_round(k) for k in range(5))}
o AS (SELECT DISTINCT key, prio FROM g5)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN o.prio IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM e JOIN s USING (key) LEFT JOIN o ON o.key = e.key AND o.prio = e.prio
"""


#: CRC-32 of a decimal number's ASCII text, a bit a step.
_CRC = """xor(4294967295, list_reduce(flatten(list_transform(range(1, length({c}::VARCHAR) + 1), lambda k: [ascii(substr({c}::VARCHAR, k::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT))"""

OP11 = f"""
WITH t AS (SELECT conv_id, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h, turn, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, h, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS k FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({_CRC.format(c="conv_id")} % 4 AS BIGINT) AS n FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS side, o.k, o.h, o.words FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.n UNION ALL SELECT c.conv_id, 1, o.k, o.h, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.n),
p AS (SELECT conv_id, row_number() OVER w AS depth, array_to_string(list(h) OVER w, '') AS node, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, k ROWS UNBOUNDED PRECEDING)),
q AS (SELECT conv_id, 0 AS depth, '' AS node, 0 AS words FROM c UNION ALL SELECT * FROM p),
e AS (SELECT conv_id, arg_max(node, depth) AS node FROM q GROUP BY 1),
s AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM e GROUP BY 1),
n AS (SELECT node, depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM q GROUP BY ALL),
f AS (SELECT n.*, u.node AS parent, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = left(n.node, 64 * (n.depth::INT - 1))),
k AS (SELECT parent AS node, count(*) AS n_children FROM f WHERE depth > 0 GROUP BY 1),
b AS (SELECT q.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens FROM f JOIN q ON q.conv_id = f.conv_id AND q.depth <= f.depth LEFT JOIN k ON k.node = f.node GROUP BY 1)
SELECT f.conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN b USING (node) LEFT JOIN k USING (node) LEFT JOIN s USING (node)
"""

OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY 1) v USING (lang) LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL) x USING (lang, source)),
p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000 * (CAST(sum(n) AS BIGINT) + 5)) // (CAST(any_value(total) AS BIGINT) + 5 * any_value(v)) AS q FROM p JOIN (SELECT lang, sum(n) AS total, any_value(v) AS v FROM g GROUP BY 1) USING (lang) GROUP BY ALL),
a AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT p.lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM a QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_embedding_near_dedup": OP2, "op3_exact_dedup": OP3, "op10_source_mixing": OP10, "op11_prefix_trie": OP11, "op12_source_divergence": OP12}
