"""Small operators over whole tables: kinds, ranges, paragraphs, counts, exports, batches, hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import paths, text
from lodestrata.operators import context, graph, lookup, snapshots
from lodestrata.plans import index, states, tools
from lodestrata.plans.compositions import _code
from lodestrata.plans.fixtures import duck
from lodestrata.sources import files
from lodestrata.streaming import jobs

QUERIES, ORACLE = {}, {}
c = F.col


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


def f12(t):
    hits = t.session_hits.select("pos", "file_path", "score")
    return lookup.attach_bonuses(hits, {"tests": t.chunks.select(c("path").alias("file_path"), c("source_id").alias("text"))}, 0.4).select("pos", "file_path", F.array_join("tests", ",").alias("tests"))


both("F12_bonus_threshold", f12, """, x AS (SELECT path AS file_path, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS v FROM chunks GROUP BY ALL)
SELECT pos, file_path, CASE WHEN score >= 0.4 THEN v END AS tests FROM session_hits LEFT JOIN x USING (file_path)""", "session_hits", "chunks")
_NODE = "CASE event_id % 5 WHEN 0 THEN 'comment' WHEN 1 THEN event_type || '_list' WHEN 2 THEN 'block_comment' WHEN 3 THEN 'list_' || event_type ELSE event_type END"
both("F15_trivial_nodes", lambda t: t.events.select("event_id", F.expr(_NODE).alias("kind")).where(~text.is_trivial_node(c("kind"))),
     f"SELECT event_id, {_NODE} AS kind FROM events WHERE event_id % 5 > 2")
both("F18_overlaps", lambda t: t.bonuses.select("bonus_id", text.overlap(c("line_lo"), c("line_hi"), F.lit(10), F.lit(20)).alias("over")),
     "SELECT bonus_id, line_lo <= 20 AND line_hi >= 10 AS over FROM bonuses", "bonuses")

_DOC = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' the ', chr(10) || '/// ' || chr(10)) WHEN 2 THEN '/**' || chr(10) || replace(text, ' a ', chr(10) || ' *' || chr(10)) ELSE replace(text, ' of ', chr(10) || chr(10)) END"
both("T11_signature_chunk", lambda t: t.documents.select("doc_id", F.md5(text.signature_chunk(c("lang"), F.expr(_DOC))).alias("chunk")),
     rf"""WITH d AS (SELECT doc_id, lang, {_DOC} AS doc FROM documents), l AS (SELECT *, string_split(doc, chr(10)) AS a FROM d),
m AS (SELECT *, list_transform(a, lambda x: NOT regexp_full_match(x, '[\s/!*]*')) AS says FROM l), s AS (SELECT *, list_position(says, true) AS first FROM m),
e AS (SELECT *, list_position(says[first:], false) AS gap FROM s),
p AS (SELECT doc_id, lang, regexp_replace(CASE WHEN contains(doc, chr(10) || chr(10)) THEN string_split(doc, chr(10) || chr(10))[1] WHEN coalesce(first, 0) = 0 OR coalesce(gap, 0) = 0 THEN doc ELSE array_to_string(a[:first + gap - 2], chr(10)) END, '\s+$', '') AS par FROM e)
SELECT doc_id, md5(CASE WHEN par = '' THEN lang ELSE lang || chr(10) || chr(10) || par END) AS chunk FROM p""")  # fmt: skip


def t24(t):
    numbers = F.slice(F.array("a", F.lit(4), "b", F.lit(9)), 1, c("n"))
    start, end = text.decode_range(numbers)
    return t.occurrences.select("symbol", "role", "a", "b", "n", start.cast("int").alias("first"), end.cast("int").alias("last"))


both("T24_decode_range", t24, """SELECT symbol, role, a, b, n, CAST(CASE WHEN n < 3 THEN 0 ELSE greatest(a, 0) + 1 END AS INT) AS first,
CAST(CASE n WHEN 3 THEN greatest(a, 0) + 1 WHEN 4 THEN greatest(b, 0) + 1 ELSE 0 END AS INT) AS last FROM occurrences""", "occurrences")
_KIND = "CASE event_id % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'ENUM' WHEN 2 THEN event_type ELSE 'type_alias' END"
both("T30_kind_tags", lambda t: t.events.select("event_id", text.tag(F.expr(_KIND), text.SYMBOL_KINDS).alias("kind"), text.tag(c("event_type"), tuple(paths.PARSER_LANGUAGES)).alias("language")),
     "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'enum' WHEN 2 THEN 'unknown' ELSE 'type_alias' END AS kind, 'unknown' AS language FROM events")
both("T31_project_relative", lambda t: t.paths.select("id", paths.project_relative(c("path"), "src/").alias("path")),
     "SELECT id, CASE WHEN starts_with(path, 'src/') THEN substr(path, 5) ELSE path END AS path FROM paths", "paths")
both("T33_counted", lambda t: t.documents.select("doc_id", text.counted(F.regexp_count("text", F.lit("the")), "match", "matches", "no matches").alias("said")),
     "SELECT doc_id, CASE n WHEN 0 THEN 'no matches' WHEN 1 THEN '1 match' ELSE CAST(n AS STRING) || ' matches' END AS said FROM (SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n FROM documents)")


def l10(t):
    rows = t.documents.select(F.concat_ws("/", "source", "lang", c("doc_id").cast("string")).alias("path"), c("text").alias("content"))
    return files.text_search(rows, "the", 500).select("path", c("line").cast("int").alias("line"))


both("L10_search_cap", l10, "SELECT file_path AS path, line_no AS line FROM lines WHERE lower(line) LIKE '%the%' ORDER BY string_split(file_path, '/'), line_no LIMIT 500", "lines")
both("L11_next_batch", lambda t: snapshots.next_batch(t.hot_signals.withColumn("promoted", F.when(c("id") % 3 > 0, c("id") % 3 == 1))).select("id", "pattern"),
     "SELECT id, pattern FROM hot_signals WHERE id % 3 <> 1 ORDER BY id LIMIT 256", "hot_signals")


def remembered(t):
    log = t.hot_signals.where("pattern = 'p:view'").select("id", c("pattern_hash").alias("raw_text"))
    return tools.remember({"observations": log}, t.hot_signals.where("pattern <> 'p:view'").select(c("pattern_hash").alias("raw_text")))


both("tool_remember", remembered, """, l AS (SELECT id, pattern_hash AS raw_text FROM hot_signals WHERE pattern = 'p:view')
SELECT * FROM l UNION ALL SELECT (SELECT max(id) FROM l) + row_number() OVER (ORDER BY pattern_hash), pattern_hash FROM hot_signals WHERE pattern <> 'p:view'""", "hot_signals")


def with_hooks(t):
    e = t.events.select(F.concat(F.lit("f"), c("user_id").cast("string")).alias("path"), c("event_type").alias("kind"), c("ts").alias("at"))
    return jobs.with_hooks(jobs.debounce(e.where("kind <> 'click'"), "600 seconds"), e.where("kind = 'click'")).withColumn("last_at", c("last_at").cast("timestamp_ntz"))


both("X03_hook_events", with_hooks, states.ORACLE["X01_debounce"].replace("FROM events)", "FROM events WHERE event_type <> 'click')", 1)
     + " UNION ALL SELECT 'f' || CAST(user_id AS STRING), event_type, 1, ts FROM events WHERE event_type = 'click'")


def a23(t):
    code = _code(t).withColumn("mtime", F.length("content").cast("bigint"))
    state = code.select("path", (c("mtime") + c("mtime") % 2).alias("mtime"))  # odd lengths count as changed
    embed = lambda x: F.when(F.length(x) % 2 == 0, F.array(F.lit(0.0)))
    return index.index_paths(code, state, embed, 1, "2024-01-01")[2]


_LINE = "'def f' || CAST(line_no AS STRING) || '():' || chr(10) || '    return ' || CAST(length(line) AS STRING)"
both("A23_index_stats", a23, f""", f AS (SELECT file_path, sum(length({_LINE}) + 1) - 1 AS m FROM lines GROUP BY ALL), k AS (SELECT length({_LINE}) % 2 = 0 AS fits FROM lines JOIN f USING (file_path) WHERE m % 2 = 1)
SELECT (SELECT count(*) FROM f) AS scanned, (SELECT count(*) FROM f WHERE m % 2 = 1) AS indexed, (SELECT count(*) FROM k WHERE fits) AS inserted, (SELECT count(*) FROM k WHERE NOT fits) AS failed, (SELECT count(*) FROM f WHERE m % 2 = 0) AS skipped""", "lines")


def h10(t):
    return lookup.occurrence_fields(t.occurrences.select("symbol", c("file_path").alias("kind"), text.role_names(c("role")).alias("role"), "file_path", c("a").alias("start_line"), c("b").alias("end_line"), c("n").alias("pos")))


_ROLES = ", ".join(f"CASE WHEN role & {m} <> 0 THEN '{n}' END" for m, n in text.ROLES)
both("H10_occurrence_fields", h10, f"""SELECT 'scip' AS source, n AS pos, file_path, a AS start_line, b AS end_line, unnest(['symbol', 'kind', 'role']) AS field, unnest([symbol, file_path, concat_ws(',', {_ROLES})]) AS value FROM occurrences""", "occurrences")
_ENDS = "SELECT r.id, {} AS line FROM relations r JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id"
_TRIPLE = "{'id': r.id, 'source': s.qualified_name, 'target': t.qualified_name, 'kind': r.kind, 'weight': r.weight}"
both("Z07_export_dot", lambda t: lookup.export_edges(t.entities, t.relations, "dot"), _ENDS.format("""'"' || s.qualified_name || '" -> "' || t.qualified_name || '" [label="' || r.kind || '"];'"""), "entities", "relations")
both("Z07_export_json", lambda t: lookup.export_edges(t.entities, t.relations, "json"), _ENDS.format(f"CAST(to_json({_TRIPLE}) AS STRING)"), "entities", "relations")
both("Z07_export_csv", lambda t: lookup.export_edges(t.entities, t.relations, "csv"), _ENDS.format("concat_ws(',', r.id, s.qualified_name, t.qualified_name, r.kind, r.weight)"), "entities", "relations")


def z09(t):
    coverage = t.tests.where("source_path IS NOT NULL").select("test_path", c("source_path").alias("file_path"), (c("confidence") * 100).cast("int").alias("lo"), (c("confidence") * 100 + 4).cast("int").alias("hi"))
    return context.covering_tests(coverage, t.edits.select(F.concat(F.lit("src/s"), F.substring("file_path", 2, 9)).alias("file_path"), "lo", "hi"))


both("Z09_covering_tests", z09, """SELECT test_path, count(DISTINCT source_path) AS n, string_agg(DISTINCT source_path, ',' ORDER BY source_path) AS files
FROM tests JOIN (SELECT DISTINCT 'src/s' || substr(file_path, 2) AS source_path, lo, hi FROM edits) e USING (source_path) WHERE e.lo <= CAST(trunc(confidence * 100 + 4) AS INT) AND e.hi >= CAST(trunc(confidence * 100) AS INT) GROUP BY ALL""", "tests", "edits")


def e08(t):
    hover = t.entities.where("id % 2 = 0").select("qualified_name", c("doc_comment").alias("text"))
    return tools.enrich_definition(t.entities.select("id", "qualified_name"), hover)


both("E08_hover", e08, "SELECT id, qualified_name, hover FROM entities LEFT JOIN (SELECT qualified_name, min(doc_comment) AS hover FROM entities WHERE id % 2 = 0 GROUP BY ALL) USING (qualified_name)", "entities")
both("W03_latest_by_file", lambda t: lookup.latest_versions(t.entities, "file_path").select("file_path", "id"),
     "SELECT file_path, id FROM entities QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY t_ingested_at DESC, id DESC) = 1", "entities")
both("H07_trace_both_ways", lambda t: t.spark.createDataFrame([(d, ",".join(tools.direction_of(d))) for d in ("upstream", "downstream", "sideways")], "asked string, walked string"),
     "SELECT * FROM (VALUES ('upstream', 'upstream'), ('downstream', 'downstream'), ('sideways', 'upstream,downstream')) v(asked, walked)")
both("J09_neighbours", lambda t: graph.directional_bfs(t.small_edges, t.spark.createDataFrame([("n1",)], "node string"), "downstream", 1),
     "SELECT DISTINCT target AS node, 1 AS depth FROM small_edges WHERE source = 'n1' AND target <> 'n1'", "small_edges")
