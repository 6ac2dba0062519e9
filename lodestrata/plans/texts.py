"""Scalar, text and reason queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import dims
from lodestrata.functions import reasons, text
from lodestrata.operators import context, vector
from lodestrata.plans.fixtures import duck
from lodestrata.sources import files

QUERIES, ORACLE = {}, {}


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


c = F.col

both("T01_qualified_name", lambda t: t.entities.select("id", text.qualified_name(c("file_path"), c("name"), c("end_line"), c("id")).alias("q")),
     "SELECT id, file_path || '::' || name || '@' || CAST(end_line AS STRING) || ':' || CAST(id AS STRING) AS q FROM entities", "entities")
both("T02_source_hash", lambda t: t.entities.select("id", F.substring(F.sha2(F.concat_ws("|", "signature", c("end_line").cast("string")), 256), 1, 16).alias("h")),
     "SELECT id, substr(sha256(signature || '|' || CAST(end_line AS STRING)), 1, 16) AS h FROM entities", "entities")
both("T03_parent_module", lambda t: t.entities.select("id", text.parent_module(c("qualified_name")).alias("module"), text.parent_module(c("name")).alias("none")),
     "SELECT id, regexp_extract(qualified_name, '^(.*)::', 1) AS module, CAST(NULL AS STRING) AS none FROM entities", "entities")
_Q = "CAST(length(coalesce({}, '')) // 4 AS BIGINT)"
both("T04_entity_tokens", lambda t: t.entities.select("id", text.entity_tokens(c("signature"), c("doc_comment"), c("qualified_name"), c("name")).alias("tokens")),
     f"SELECT id, {_Q.format('signature')} + {_Q.format('doc_comment')} + {_Q.format('qualified_name')} + 8 AS tokens FROM entities", "entities")
both("T05_hit_tokens", lambda t: t.lines.select("doc_id", "line_no", text.hit_tokens(c("line"), c("file_path")).alias("tokens")),
     f"SELECT doc_id, line_no, {_Q.format('line')} + {_Q.format('file_path')} + 8 AS tokens FROM lines", "lines")
both("T06_summary_tokens", lambda t: t.documents.select("doc_id", text.summary_tokens(c("text"), c("n_chars")).alias("tokens")),
     "SELECT doc_id, CAST(strlen(text) // 4 + 8 * n_chars AS BIGINT) AS tokens FROM documents")
both("T07_byte_tokens", lambda t: t.documents.select("doc_id", text.byte_tokens(c("text")).alias("tokens")), "SELECT doc_id, CAST(greatest(1, (strlen(text) + 3) // 4) AS BIGINT) AS tokens FROM documents")
# 2,048 bytes as hex without a character that the cut splits
ORACLE["T08_cut_bytes"] = r"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
k AS (SELECT doc_id, CASE WHEN length(h) <= 4096 THEN h ELSE regexp_replace(substr(h, 1, 4096), '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$', '\1') END AS cut FROM d)
SELECT doc_id, sha256(unhex(cut)) AS sha, CAST(length(cut) // 2 AS INT) AS bytes FROM k"""
QUERIES["T08_cut_bytes"] = lambda t: t.documents.select("doc_id", F.sha2(text.cut_bytes(c("text"), 2048), 256).alias("sha"), F.octet_length(text.cut_bytes(c("text"), 2048)).alias("bytes"))
both("T09_slice_lines", lambda t: t.documents.select("doc_id", F.md5(text.slice_lines(c("text"), F.lit(2), F.lit(4))).alias("slice")),
     """, l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), m AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM l)
SELECT doc_id, CASE WHEN len(a) >= 2 THEN md5(array_to_string(a[2:least(4, len(a))], chr(10))) END AS slice FROM m""".lstrip(", ").replace("l AS", "WITH l AS", 1))  # fmt: skip
both("T10_signature", lambda t: t.documents.select("doc_id", F.md5(text.signature(F.concat(F.lit("  pub fn f(\n   a: u8 )  "), c("lang"), F.lit(" { body; }")))).alias("sig")),
     "SELECT doc_id, md5('pub fn f( a: u8 )  ' || lang) AS sig FROM documents")
both("T12_first_lines", lambda t: t.documents.select("doc_id", F.md5(text.first_lines(c("text"))).alias("head")),
     """SELECT doc_id, md5(CASE WHEN len(a) = 0 THEN text ELSE array_to_string(a[1:3], chr(10)) END) AS head FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM documents)""")


def _rules(column: str, rules, default: str) -> str:
    tests = [" OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules]
    return "CASE " + " ".join(f"WHEN {x}" for x in tests) + f" ELSE '{default}' END"


_PAD = "SELECT event_id, tool, ' ' || lower(coalesce(reason, '')) || ' ' AS p FROM reasons"
both("T13_intent", lambda t: t.reasons.select("event_id", reasons.intent(c("reason")).alias("intent")), f"SELECT event_id, {_rules('p', dims.INTENT_WORDS, 'understand')} AS intent FROM ({_PAD})", "reasons")
both("T14_action", lambda t: t.reasons.select("event_id", reasons.action(c("reason")).alias("action")), f"SELECT event_id, {_rules('p', dims.ACTION_WORDS, 'read')} AS action FROM ({_PAD})", "reasons")
_IN = ", ".join(f"'{w}'" for w in dims.DOMAIN_WORDS)
both("T15_domains", lambda t: t.reasons.select("event_id", F.array_join(reasons.domains(c("reason")), ",").alias("domains")),
     f"""SELECT event_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'p': list_position(w, x), 'x': x}})), lambda s: s.x), ','), '') AS domains
FROM (SELECT event_id, list_filter(regexp_split_to_array(lower(coalesce(reason, '')), '[\\s,.;:!?()]'), lambda x: x IN ({_IN})) AS w FROM reasons)""", "reasons")  # fmt: skip
_GAP = "|".join(g.replace("'", "''") for g in dims.GAP_PHRASES)
both("T16_gaps", lambda t: t.reasons.select("event_id", F.array_join(reasons.gaps(c("reason")), "|").alias("gaps")),
     f"""SELECT event_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'p': list_position(w, x), 'x': x}})), lambda s: s.x), '|'), '') AS gaps
FROM (SELECT event_id, list_filter(list_transform(regexp_extract_all(lower(coalesce(reason, '')), '({_GAP})([a-z0-9_\\- ]{{0,40}})', 2), lambda x: trim(x)), lambda x: x <> '') AS w FROM reasons)""", "reasons")  # fmt: skip
_TOOLS = " ".join(f"WHEN tool = '{k}' THEN '{v}'" for k, v in dims.TOOL_QUERY_TYPES.items())
both("T17_query_type", lambda t: t.reasons.select("event_id", reasons.query_type(c("tool"), c("reason")).alias("query_type")),
     f"SELECT event_id, CASE {_TOOLS} ELSE {_rules('p', [(q, (w,)) for w, q in dims.KEYWORD_QUERY_TYPES], 'understand_code')} END AS query_type FROM ({_PAD})", "reasons")


def t18(t):
    rows = t.documents.select(F.concat_ws("/", "source", "lang", c("doc_id").cast("string")).alias("path"), c("text").alias("content"))
    low, high = files.text_search(rows, r"th[ae]n\b"), files.text_search(rows, r"The\b")
    mark = lambda d, k: d.select(F.lit(k).alias("pattern"), "path", c("line").cast("bigint").alias("line"), F.md5("preview").alias("preview"))
    return mark(low, "low").unionByName(mark(high, "high"))


# Previews hold 1,024 bytes without a character that the cut splits.
_PREVIEW = r"""md5(unhex(CASE WHEN strlen(line) <= 1024 THEN hex(encode(line)) ELSE regexp_replace(substr(hex(encode(line)), 1, 2048), '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$', '\1') END)) AS preview"""
both("T18_text_search", t18, rf"""SELECT 'low' AS pattern, file_path AS path, CAST(line_no AS BIGINT) AS line, {_PREVIEW} FROM lines WHERE regexp_matches(line, '(?i)th[ae]n\b') UNION ALL SELECT 'high', file_path, CAST(line_no AS BIGINT), {_PREVIEW} FROM lines WHERE regexp_matches(line, 'The\b')""", "lines")
both("T18_matching_lines", lambda t: t18(t).select("pattern", "path", "line"), """, x AS (SELECT *, line_no AS line_number FROM lines)
SELECT 'low' AS pattern, file_path AS path, CAST(line_no AS BIGINT) AS line FROM lines WHERE regexp_matches(line, '(?i)th[ae]n\\b') UNION ALL SELECT 'high', file_path, CAST(line_no AS BIGINT) FROM lines WHERE regexp_matches(line, 'The\\b')""", "lines")
both("T19_jaccard", lambda t: t.lines.select("doc_id", "line_no", F.round(text.jaccard(c("line"), F.lit("the of and a in is that")), 9).alias("j")),
     """, w AS (SELECT doc_id, line_no, list_distinct(list_filter(string_split(line, ' '), lambda x: x <> '')) AS w, ['the', 'of', 'and', 'a', 'in', 'is', 'that'] AS q FROM lines)
SELECT doc_id, line_no, round(len(list_intersect(w, q)) / (len(w) + 7 - len(list_intersect(w, q))), 9) AS j FROM w""", "lines")  # fmt: skip
both("T20_severity", lambda t: t.diagnostics.select("id", text.quality_severity(c("severity")).alias("severity"), text.quality_category(c("severity")).alias("category")),
     "SELECT id, CASE WHEN severity IS NULL THEN 'medium' ELSE CASE severity WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END END AS severity, CASE WHEN severity = 1 THEN 'type_error' ELSE 'lint' END AS category FROM diagnostics", "diagnostics")
both("T21_default_server", lambda t: t.documents.select("doc_id", text.mapped(F.when(c("doc_id") % 3 == 0, "python").when(c("doc_id") % 3 == 1, "cpp").otherwise("perl"), text.SERVERS).alias("server")),
     "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pyright' WHEN 1 THEN 'clangd' END AS server FROM documents")
_KINDS = " ".join(f"WHEN k IN ({', '.join(map(str, v))}) THEN '{n}'" for n, v in text.ENTITY_KINDS.items())
both("T22_entity_kind", lambda t: t.events.select("event_id", text.entity_kind(c("event_id") % 28).alias("kind")), f"SELECT event_id, CASE {_KINDS} ELSE 'symbol' END AS kind FROM (SELECT event_id, event_id % 28 AS k FROM events)")
_ROLES = ", ".join(f"CASE WHEN event_id % 128 & {m} <> 0 THEN '{n}' END" for m, n in text.ROLES)
both("T23_role_names", lambda t: t.events.select("event_id", text.role_names((c("event_id") % 128).cast("int")).alias("roles")), f"SELECT event_id, concat_ws(',', {_ROLES}) AS roles FROM events")
both("T25_utc_text", lambda t: t.events.select("event_id", text.utc_text(c("event_id") * 86399).alias("at")), "SELECT event_id, strftime(make_timestamp(event_id * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM events")
both("T26_expires_at", lambda t: t.events.select("event_id", text.expires_at(F.lit(9223372036854775000), c("event_id") % 2000).alias("at")),
     "SELECT event_id, CASE WHEN event_id % 2000 > 807 THEN 9223372036854775807 ELSE 9223372036854775000 + event_id % 2000 END AS at FROM events")
both("T32_symbol_count", lambda t: t.documents.select("doc_id", F.size(text.words(c("text"))).alias("n"), (F.size(text.words(c("text"))) * 2).alias("dependent")),
     "SELECT doc_id, CAST(n AS INT) AS n, CAST(2 * n AS INT) AS dependent FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)")
both("T34_edge_kind", lambda t: t.events.select("event_id", text.edge_kind(F.when(c("event_id") % 2 == 0, F.concat(F.lit("other:"), "event_type")).otherwise(c("event_type"))).alias("kind")),
     "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Other(' || event_type || ')' ELSE upper(event_type[1]) || event_type[2:] END AS kind FROM events")
both("A19_import_count", lambda t: t.lines.groupBy("doc_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.when(F.rlike("line", F.lit("^[A-M]")), F.lit("import ")).otherwise(F.lit("")), "line")))).alias("code")).select("doc_id", text.import_count(c("code"), F.lit("python")).alias("imports")),
     r"SELECT doc_id, CAST(count(*) FILTER (regexp_matches(line, '^[A-M]') OR regexp_matches(line, '^[ \t]*(import|from)[ \t]+[0-9A-Za-z_.]')) AS INT) AS imports FROM lines GROUP BY ALL", "lines")
both("F19_decision_title", lambda t: t.hot_decisions.select("id", text.decision_title(c("title"), c("description")).alias("title")), "SELECT id, coalesce(nullif(title, ''), left(description, 80), '') AS title FROM hot_decisions", "hot_decisions")
both("F11_threshold", lambda t: context.above_threshold(t.session_hits, 0.1), "SELECT * FROM session_hits WHERE score >= 0.1", "session_hits")
_A18 = """, f AS (SELECT *, length(coalesce(snippet, '')) // 4 + length(file_path) // 4 + 8 AS tokens FROM session_hits WHERE (session_id, file_path) NOT IN (SELECT session_id, file_path FROM session_files)),
t AS (SELECT session_id, count(*) AS total_input FROM session_hits GROUP BY ALL), g AS (SELECT session_id, sum(tokens) FILTER (score >= 0.1) AS tc, count(*) AS n, count(*) FILTER (score < 0.1) AS filtered FROM f GROUP BY ALL)
SELECT session_id, total_input, CAST(coalesce(tc, 0) AS BIGINT) AS token_count, total_input - coalesce(n, 0) AS deduped, coalesce(filtered, 0) AS filtered FROM t LEFT JOIN g USING (session_id)"""
both("A18_response_counters", lambda t: context.assemble_response(t.session_hits, t.session_files)[1], _A18, "session_hits", "session_files")


def a17(t):
    call = t.edits.select("session_id").distinct().withColumn("reason", F.concat(F.lit("about key"), "session_id")).withColumn("files", F.array(F.concat(F.lit("f"), c("session_id").cast("int") % 7)))
    return context.analyze_feedback(t.bonuses, call, t.edits)


_A17 = """, call AS (SELECT DISTINCT session_id, 'about key' || session_id AS reason, 'f' || CAST(CAST(session_id AS INT) % 7 AS STRING) AS file FROM edits),
x AS (SELECT b.session_id, b.bonus_id, b.bonus_type, bool_or(coalesce(CASE b.bonus_type WHEN 'pitfall' THEN contains(lower(c.reason), lower(b.keyword)) WHEN 'convention' THEN contains(lower(e.content), lower(b.keyword))
  WHEN 'related_code' THEN c.file = b.file_path WHEN 'quality_issue' THEN e.file_path = b.file_path AND greatest(line_lo, lo) <= least(line_hi, hi) ELSE coalesce(c.file = b.file_path, false) OR coalesce(e.file_path = b.file_path, false) END, false)) AS hit
FROM bonuses b LEFT JOIN call c USING (session_id) LEFT JOIN edits e USING (session_id) GROUP BY ALL)
SELECT session_id, bonus_id, bonus_type, CASE WHEN NOT hit THEN 'ignored' WHEN bonus_type = 'convention' THEN 'followed' WHEN bonus_type = 'quality_issue' THEN 'fixed' ELSE 'used' END AS signal,
CAST(CASE WHEN NOT hit THEN -0.01 WHEN bonus_type IN ('pitfall', 'quality_issue') THEN 0.1 ELSE 0.05 END AS DOUBLE) AS delta FROM x"""
both("A17_feedback", a17, _A17, "bonuses", "edits")
both("Z02_relevance", lambda t: t.facts.select("entity", "observed", F.round(context.relevance(c("confidence") / 100, c("entity") / 150, F.lit(0.5), c("observed") / 1e6), 9).alias("score")),
     "SELECT entity, observed, round(0.3 * (confidence / 100) + 0.4 * (entity / 150) + 0.2 * 0.5 + 0.1 * (observed / 1e6), 9) AS score FROM facts", "facts")
both("Z03_decay", lambda t: t.facts.select("entity", "observed", F.round(context.decay(c("confidence"), 0.95, c("observed") / 100000), 9).alias("importance")),
     "SELECT entity, observed, round(confidence * pow(0.95, observed / 100000), 9) AS importance FROM facts", "facts")
both("Z05_latency_report", lambda t: context.latency_report(t.tool_calls).select("tool", "calls", *[F.round(x, 6).alias(x) for x in ("p50", "p95", "p99", "hit_rate")]),
     "SELECT tool, count(*) AS calls, round(quantile_cont(elapsed_ms, 0.5), 6) AS p50, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95, round(quantile_cont(elapsed_ms, 0.99), 6) AS p99, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate FROM tool_calls GROUP BY ALL", "tool_calls")


def v01(t):
    chunks = t.embeddings.select(c("vec_id").alias("id"), "embedding")
    q = chunks.where("id = 0").first()["embedding"]
    return vector.find_similar(chunks, list(q), 10).select("id", F.round("distance", 9).alias("distance"), F.round("similarity", 9).alias("similarity"))


_D = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
both("V01_find_similar", v01, f"SELECT e.vec_id AS id, round({_D}, 9) AS distance, round(1 / (1 + {_D}), 9) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_D}, e.vec_id LIMIT 10")


def v02(t):
    chunks = t.embeddings.select(c("vec_id").alias("id"), "embedding")
    asked = chunks.where("id % 50 = 0").select(c("id").alias("query_id"), c("embedding").alias("v"))  # the stated query set
    return vector.knn_join(asked, chunks, 10).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


both("V02_knn_join", v02, f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INT) AS rank, id, round(d, 6) AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_D} AS d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) QUALIFY rank <= 10""")
both("T27_normalise", lambda t: t.embeddings.select("vec_id", F.round(F.element_at(vector.normalise(c("embedding")), 1), 6).alias("first")),
     "SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first FROM embeddings")
