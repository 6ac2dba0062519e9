"""Tool queries (2.15), fan-out and ingestion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import dims
from lodestrata.functions import parsing, paths, text
from lodestrata.operators import fusion, lookup
from lodestrata.plans import fanout, index, merging, tools
from lodestrata.plans.fixtures import duck
from lodestrata.plans.merging import _A06, _S
from lodestrata.plans.texts import _PREVIEW
from lodestrata.plans.traversals import blast_sql

QUERIES, ORACLE = {}, {}


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


def _code(t):
    """Documents as source files: half of their lines become Python functions."""
    body = F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.lit("def f"), F.col("line_no").cast("string"), F.lit("():\n    return "), F.length("line").cast("string")).alias("l"))))["l"])
    return t.lines.groupBy("file_path").agg(body.alias("content")).select(F.concat("file_path", F.lit(".py")).alias("path"), F.lit("python").alias("language"), "content")


both("tool_find_definition", lambda t: tools.find_definition(vars_(t), "Brand#12")[1],
     """SELECT r.id AS edge_id, r.target_id, r.source_id, coalesce(s.qualified_name, s.name) AS caller, s.file_path, s.start_line FROM relations r JOIN entities s ON s.id = r.source_id WHERE r.kind = 'calls'
AND r.target_id = (SELECT id FROM entities WHERE name = 'Brand#12' OR lower(qualified_name) LIKE '%::brand#12' ORDER BY t_ingested_at DESC, id DESC LIMIT 1)""", "entities", "relations")  # fmt: skip
both("tool_find_references", lambda t: tools.find_references(vars_(t), "Brand#23"),
     """SELECT r.kind, r.id, coalesce(s.qualified_name, s.name) AS referrer FROM relations r JOIN entities s ON s.id = r.source_id
WHERE r.target_id = (SELECT id FROM entities WHERE name = 'Brand#23' OR lower(qualified_name) LIKE '%::brand#23' ORDER BY t_ingested_at DESC, id DESC LIMIT 1)""", "entities", "relations")  # fmt: skip
both("tool_get_architecture", lambda t: tools.get_architecture({"edges": t.edges}, 256)[0],
     f", e AS (SELECT * FROM ({_A06}) ORDER BY coupling DESC, source, target, pos LIMIT 256) SELECT source AS module FROM e UNION SELECT target FROM e", "edges")
both("tool_check_quality", lambda t: tools.check_quality({"issues": t.issues, "tests": t.tests})[0].groupBy("severity").agg(F.count("*").alias("n")),
     f"SELECT CASE s {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(dims.SEVERITIES))} END AS severity, count(*) AS n FROM (SELECT min({_S}) AS s FROM issues GROUP BY file_path, line_start, category) GROUP BY 1", "issues")
both("tool_type_check", lambda t: tools.type_check({"diagnostics": t.diagnostics}).groupBy("source", "code").agg(F.count("*").alias("n")),
     "SELECT source, code, count(*) AS n FROM diagnostics WHERE severity = 1 AND (coalesce(source IN ('rust-analyzer', 'pyright', 'tsserver', 'typescript', 'mypy'), false) OR coalesce(regexp_matches(code, '^(E|TS2|TS7|report)'), false)) GROUP BY ALL", "diagnostics")
both("tool_find_definition_row", lambda t: tools.find_definition(vars_(t), "Brand#12")[0].select("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line"),
     """SELECT id, kind, name, qualified_name, file_path, start_line, end_line FROM entities WHERE name = 'Brand#12' OR lower(qualified_name) LIKE '%::brand#12' ORDER BY t_ingested_at DESC, id DESC LIMIT 1""", "entities")  # fmt: skip
both("tool_get_architecture_edges", lambda t: tools.get_architecture({"edges": t.edges}, 256)[1].select("source", "target", "edge_kind", "origin", "source_id", "coupling", "contributors"),
     f"SELECT * EXCLUDE (pos) FROM (SELECT * FROM ({_A06}) ORDER BY coupling DESC, source, target, pos LIMIT 256)", "edges")
QUERIES["tool_check_quality_issues"] = lambda t: tools.check_quality({"issues": t.issues, "tests": t.tests})[0].drop("ord")
ORACLE["tool_check_quality_issues"] = merging.ORACLE["A08_merge_issues"]
QUERIES["tool_check_quality_tests"] = lambda t: tools.check_quality({"issues": t.issues, "tests": t.tests})[1]
ORACLE["tool_check_quality_tests"] = merging.ORACLE["A09_merge_tests"]
both("tool_type_check_rows", lambda t: tools.type_check({"diagnostics": t.diagnostics}).select("id", "severity", "source", "code"),
     "SELECT id, severity, source, code FROM diagnostics WHERE severity = 1 AND (coalesce(source IN ('rust-analyzer', 'pyright', 'tsserver', 'typescript', 'mypy'), false) OR coalesce(regexp_matches(code, '^(E|TS2|TS7|report)'), false))", "diagnostics")
both("tool_get_conventions", lambda t: tools.get_conventions({"conventions": t.hot_signals.withColumnRenamed("pattern", "category")}, "p:click"), "SELECT id, pattern_hash, pattern AS category FROM hot_signals WHERE pattern = 'p:click'", "hot_signals")


def named(t):
    """The name of an entity that has edges: of the newest of each name, the target of the first relation."""
    newest = lookup.latest_versions(t.entities, "qualified_name").select(F.col("id").alias("target_id"), "qualified_name")
    return t.relations.join(newest, "target_id").orderBy("id").first()["qualified_name"]


_NAMED = """(SELECT e.id FROM (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY t_ingested_at DESC, id DESC) = 1) e JOIN relations r ON r.target_id = e.id ORDER BY r.id LIMIT 1)"""
_SIDES = f""", s AS (SELECT source_id AS id, target_id AS peer_id, id AS edge_id, kind, 'out' AS direction FROM relations UNION ALL SELECT target_id, source_id, id, kind, 'in' FROM relations),
x AS (SELECT s.peer_id, s.id, s.edge_id, s.kind, s.direction, coalesce(p.qualified_name, p.name) AS peer FROM s JOIN entities p ON p.id = s.peer_id WHERE s.id = {_NAMED})"""
both("P10_explain_symbol", lambda t: index.explain_symbol(t.entities, t.relations, named(t))[0].select("id", "kind", "qualified_name", "file_path", "start_line", "inbound_relation_count", "outbound_relation_count"),
     f"{_SIDES} SELECT id, kind, qualified_name, file_path, start_line, (SELECT count(*) FROM x WHERE direction = 'in') AS inbound_relation_count, (SELECT count(*) FROM x WHERE direction = 'out') AS outbound_relation_count FROM entities WHERE id = {_NAMED}", "entities", "relations")
both("P10_symbol_edges", lambda t: index.explain_symbol(t.entities, t.relations, named(t), 3)[1],
     f"{_SIDES} SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY kind, peer, edge_id) AS INT) AS rank FROM x QUALIFY rank <= 3", "entities", "relations")
_TOP = f"e AS (SELECT * FROM ({_A06}) ORDER BY coupling DESC, source, target, pos LIMIT 1024)"
ORACLE["tool_trace_dependencies"] = duck("edges").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", {_TOP}, s AS (SELECT min(target) AS node FROM edges),
d AS (SELECT node, 0 AS depth FROM s UNION SELECT e.target, d.depth + 1 FROM d JOIN e ON e.source = d.node WHERE d.depth < 3), p AS (SELECT node, 0 AS depth FROM s UNION SELECT e.source, p.depth + 1 FROM p JOIN e ON e.target = p.node WHERE p.depth < 3)
SELECT node, min(depth) AS depth, 'downstream' AS direction FROM d GROUP BY node HAVING min(depth) > 0 UNION ALL SELECT node, min(depth), 'upstream' FROM p GROUP BY node HAVING min(depth) > 0"""
ORACLE["tool_blast_radius"] = duck("edges").rstrip() + f", {_TOP}, " + blast_sql("u AS (SELECT source, target, edge_kind, coupling, pos FROM e)", "SELECT min(target) AS node, 0 AS depth, 1.0::DOUBLE AS weight, NULL::VARCHAR AS parent, NULL::VARCHAR AS via, 1 AS q, min(target) AS path FROM edges") + " SELECT node, depth, round(weight, 9) AS weight FROM a WHERE depth > 0"
QUERIES["tool_trace_dependencies"] = lambda t: tools.trace_dependencies({"edges": t.edges}, t.edges.agg(F.min("target")).first()[0])
QUERIES["tool_blast_radius"] = lambda t: tools.blast_radius({"edges": t.edges}, [t.edges.agg(F.min("target")).first()[0]], 2)[0].select("node", "depth", F.round("weight", 9).alias("weight"))


def vars_(t):
    return {"entities": t.entities, "relations": t.relations}


def review(t):
    first = t.issues.agg(F.min("file_path")).first()[0]
    return tools.review_changes({"edges": t.edges, "issues": t.issues}, [first, t.edges.agg(F.min("target")).first()[0]])


QUERIES["tool_review_changes"] = review


def search(t):
    rows = t.documents.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return tools.search_code({"entities": t.entities, "files": rows}, "an", 500).withColumn("preview", F.md5("preview"))


both("tool_search_code", search, rf""", s AS (SELECT file_path AS file, CAST(coalesce(start_line, 0) AS INT) AS line, md5(coalesce(qualified_name, name)) AS preview, 0 AS side, row_number() OVER (ORDER BY t_ingested_at DESC, id DESC) AS pos FROM entities WHERE lower(name) LIKE '%an%' OR lower(qualified_name) LIKE '%an%' QUALIFY pos <= 500),
x AS (SELECT file_path AS file, line_no AS line, {_PREVIEW}, 1 AS side, row_number() OVER (ORDER BY string_split(file_path, '/'), line_no) AS pos FROM lines WHERE regexp_matches(line, '(?i)an') QUALIFY pos <= 500),
a AS (SELECT * FROM s UNION ALL SELECT * FROM x), f AS (SELECT file, line, min((side, pos)) AS first FROM a GROUP BY ALL), t AS (SELECT * FROM f ORDER BY first LIMIT 500), z AS (SELECT count(*) AS n, max(first) AS last FROM t),
g AS (SELECT file, line, arg_min(preview, (side, pos)) AS first_preview, min(side) AS side, count(*) FILTER (side = 1) AS texts, arg_max(preview, pos) FILTER (side = 1) AS last_text FROM a JOIN t USING (file, line), z WHERE n < 500 OR (a.side, a.pos) <= last GROUP BY ALL)
SELECT file, line, CASE WHEN side = 0 AND texts > 0 OR texts > 1 THEN 'both' WHEN side = 0 THEN 'symbol' ELSE 'text' END AS source, CASE WHEN side = 0 AND texts > 0 OR texts > 1 THEN last_text ELSE first_preview END AS preview FROM g""", "entities", "lines")


def edit_context(t):
    have = t.spark.createDataFrame([("src0/en/0",)], "file_path string")
    return tools.get_context_for_edit({"hits": t.group_hits}, have, 4000).drop("contributing").withColumn("score", F.round("score", 9))


_EW = merging._case("grp", dict(zip(dims.GROUPS, dims.GROUP_WEIGHTS["get_context_for_edit"], strict=True)), 0)
both("tool_get_context_for_edit", edit_context, f""", f AS (SELECT file_path, start_line, end_line, sum(w / (60 + rank)) AS s, arg_min(snippet, (-w, grp, rank)) AS snippet FROM (SELECT *, CAST({_EW} AS DOUBLE) AS w FROM group_hits WHERE status = 'available') GROUP BY file_path, start_line, end_line HAVING s <> 0),
k AS (SELECT *, CAST(length(coalesce(snippet, '')) // 4 + length(file_path) // 4 + 8 AS BIGINT) AS tokens FROM f WHERE file_path <> 'src0/en/0'),
r AS (SELECT *, sum(tokens) OVER (ORDER BY s DESC, string_split(file_path, '/'), start_line, end_line ROWS UNBOUNDED PRECEDING) AS running FROM k)
SELECT file_path, start_line, end_line, round(s, 9) AS score, snippet, tokens, CAST(running AS BIGINT) AS running FROM r WHERE running <= 4000""", "group_hits")


def understand(t):
    code = _code(t)
    return index.explain_files(code, parsing.extract_symbols(code), t.entities)


both("tool_understand_code", understand, """SELECT file_path || '.py' AS path, 'python' AS language, CAST(2 * count(*) AS INT) AS line_count, 0 AS imports,
  array_to_string(list_transform(range(1, least(100, count(*)) + 1), lambda k: 'function f' || CAST(k AS STRING)), ',') AS symbols, CAST(count(*) AS INT) AS symbol_total, CAST(0 AS BIGINT) AS stored FROM lines GROUP BY file_path""", "lines")


def chunked(t):
    code = _code(t)
    return parsing.chunk_symbols(code, parsing.extract_symbols(code)).select("id", "path", "symbol_name", "symbol_kind", "tokens", "form")


both("P07_chunk_symbols", chunked, """SELECT file_path || '.py:' || CAST(2 * line_no - 1 AS STRING) || ':' || CAST(2 * line_no AS STRING) AS id, file_path || '.py' AS path, 'f' || CAST(line_no AS STRING) AS symbol_name, 'function' AS symbol_kind,
  CAST((length('def f' || CAST(line_no AS STRING) || '():x    return ' || CAST(length(line) AS STRING)) + 3) // 4 AS BIGINT) AS tokens, 'full' AS form FROM lines""", "lines")


def fan(t):
    r = fanout.Registry()
    r.install("probe", "G2", lambda spark, q: t.hits.where("source = 'probe'").drop("source"))
    r.install("rip", "G1", lambda spark, q: t.hits.where("source = 'ripgrep'").drop("source"))
    r.install("weightless", "G6", lambda spark, q: 1 / 0)
    r.install("broken", "G3", lambda spark, q: [][0])
    rows, status = fanout.fused_query(t.spark, r, "find_definition", {})
    n = status.groupBy("status").agg(F.count("*").alias("sources"))
    return rows.agg(F.count("*").alias("fused"), F.round(F.sum("fused_score"), 6).alias("total")).join(n.where("status = 'errored'"))


both("E01_fan_out", fan, """SELECT count(*) AS fused, round(sum(s), 6) AS total, 'errored' AS status, CAST(1 AS BIGINT) AS sources FROM (SELECT sum(CASE source WHEN 'probe' THEN 1.5 ELSE 3.0 END / (60 + rank)::DOUBLE) AS s FROM hits WHERE source <> 'lancedb' GROUP BY file_path, start_line, end_line)""", "hits")
both("F17_activation", lambda t: t.paths.select("id", F.array_compact(F.array(paths.language(F.col("path")))).alias("on_language")).where((F.size("on_language") == 0) | F.array_contains("on_language", "go")).select("id"),
     "SELECT id FROM paths WHERE NOT regexp_matches(lower(path), '\\.(rs|py|pyi|tsx|mjs|java|h|hpp|rb|json|mts)$')", "paths")
both("F16_expired", lambda t: t.calls.groupBy("session_id").agg(F.min("at").alias("created")).withColumn("expires", text.expires_at(F.col("created"), F.lit(86400))).where(text.is_expired(F.col("expires"), F.lit(90000))),
     'SELECT session_id, min("at") AS created, min("at") + 86400 AS expires FROM calls GROUP BY session_id HAVING min("at") + 86400 <= 90000', "calls")
both("U01_concatenate", lambda t: t.hits.select("source", "file_path").unionByName(t.group_hits.select(F.col("grp").alias("source"), "file_path")).groupBy("source").agg(F.count("*").alias("n")),
     "SELECT source, count(*) AS n FROM (SELECT source FROM hits UNION ALL SELECT grp FROM group_hits) GROUP BY ALL", "hits", "group_hits")
both("U04_untouched", lambda t: t.issue_table.join(t.report.select("message").distinct(), "message", "left_anti").select("id"), "SELECT id FROM issue_table WHERE message NOT IN (SELECT message FROM report)", "issue_table", "report")
both("L02_capped_edges", lambda t: lookup.edges_of(t.entities, t.relations, t.entities, 1).groupBy("direction").agg(F.count("*").alias("n"), F.max("total").alias("most")),
     """, s AS (SELECT source_id AS id, target_id AS peer_id, 'out' AS direction FROM relations UNION ALL SELECT target_id, source_id, 'in' FROM relations), k AS (SELECT id, direction, count(*) AS total FROM s WHERE id IN (SELECT id FROM entities) AND peer_id IN (SELECT id FROM entities) GROUP BY ALL)
SELECT direction, count(*) AS n, max(total) AS most FROM k GROUP BY ALL""", "entities", "relations")  # fmt: skip
both("L01_fused_order", lambda t: fusion.fuse_rrf(t.hits).orderBy(*fusion.fused_order()).limit(50).select("file_path", "start_line"),
     """SELECT file_path, start_line FROM (SELECT file_path, start_line, end_line, list_sum(list_sort(list(CASE source WHEN 'probe' THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END / (60 + rank)))) AS s FROM hits GROUP BY ALL) ORDER BY s DESC, string_split(file_path, '/'), start_line, end_line LIMIT 50""", "hits")  # fmt: skip
