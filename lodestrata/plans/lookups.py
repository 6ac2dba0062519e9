"""Lookup and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import paths, text
from lodestrata.operators import lookup, snapshots
from lodestrata.plans.fixtures import duck
from lodestrata.sources import files

QUERIES, ORACLE = {}, {}


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


_E = "id, kind, name, qualified_name, file_path, start_line"
_COLS = _E.split(", ")

both("S03_count_capped", lambda t: t.spark.createDataFrame([(files.count_capped(t.paths, 500),)], "n bigint"), "SELECT least(count(*), 501) AS n FROM paths", "paths")
both("S04_list_entities", lambda t: t.entities.select(*_COLS).orderBy("id"), f"SELECT {_E} FROM entities", "entities")
both("S05_list_calls", lambda t: t.relations.where("kind = 'calls'").orderBy("id"), "SELECT * FROM relations WHERE kind = 'calls'", "relations")


def s06(t):
    o = t.occurrences
    span = F.when(F.col("n") == 4, F.array("a", F.lit(0), "b", F.lit(1))).when(F.col("n") == 3, F.array("a", F.lit(0), F.lit(5))).otherwise(F.array("a", "b"))
    docs = o.groupBy(F.col("file_path").alias("path")).agg(
        F.collect_set(F.struct(F.col("symbol"), F.substring_index("symbol", "#", 1).alias("kind"))).alias("symbols"),
        F.collect_list(F.struct("symbol", span.alias("range"), F.col("role").alias("roles"))).alias("occurrences"),
    )
    ext = t.spark.createDataFrame([("click#1", "external"), ("nowhere", "external")], "symbol string, kind string")
    return files.load_occurrences(docs, ext).withColumn("role", text.role_names(F.col("role")))


_ROLES = ", ".join(f"CASE WHEN role & {m} <> 0 THEN '{n}' END" for m, n in text.ROLES)
both("S06_load_occurrences", s06, f"""SELECT symbol, string_split(symbol, '#')[1] AS kind, file_path, CAST(CASE WHEN n IN (3, 4) THEN greatest(a, 0) + 1 ELSE 0 END AS INT) AS start_line,
  CAST(CASE n WHEN 4 THEN greatest(b, 0) + 1 WHEN 3 THEN greatest(a, 0) + 1 ELSE 0 END AS INT) AS end_line, concat_ws(',', {_ROLES}) AS role FROM occurrences""", "occurrences")

both("F01_entity_by_id", lambda t: lookup.entity_by_id(t.entities, 17).select(*_COLS), f"SELECT {_E} FROM entities WHERE id = 17", "entities")
both("F02_entity_by_qualified_name", lambda t: lookup.entity_by_qualified_name(t.entities, t.entities.agg(F.min("qualified_name")).first()[0]).select(*_COLS),
     f"SELECT {_E} FROM entities WHERE qualified_name = (SELECT min(qualified_name) FROM entities) ORDER BY t_ingested_at DESC, id DESC LIMIT 1", "entities")
both("F02_latest_versions", lambda t: lookup.latest_versions(t.entities, "qualified_name").select(*_COLS),
     f"SELECT {_E} FROM entities QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY t_ingested_at DESC, id DESC) = 1", "entities")


def f03(t):
    first = t.entities.agg(F.min("file_path").alias("f")).first()["f"]
    return lookup.entities_by_file(t.entities, first).select(*_COLS)


both("F03_entities_by_file", f03, f"SELECT {_E} FROM entities WHERE file_path = (SELECT min(file_path) FROM entities)", "entities")
both("F04_search_by_name", lambda t: lookup.search_by_name(t.entities, "bRAND#_2", 50).select(*_COLS),
     f"SELECT {_E} FROM entities WHERE lower(name) LIKE '%brand#_2%' OR lower(qualified_name) LIKE '%brand#_2%' ORDER BY t_ingested_at DESC, id DESC LIMIT 50", "entities")
_PARENT = "CASE WHEN contains(qualified_name, '::') THEN regexp_extract(qualified_name, '(?s)^(.*)::', 1) END AS parent_module"
both("F05_resolve_symbols", lambda t: lookup.resolve_symbols(t.entities, t.symbols).select("symbol", *_COLS, "parent_module"),
     f"""SELECT symbol, {_E}, {_PARENT} FROM symbols JOIN entities ON name = symbol OR qualified_name = symbol OR (contains(qualified_name, '::') AND lower(string_split(qualified_name, '::')[-1]) = lower(symbol))
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t_ingested_at DESC, id DESC) = 1""", "symbols", "entities")  # fmt: skip
both("F05_resolve_symbol", lambda t: lookup.resolve_symbol(t.entities, "Brand#23").select(*_COLS, "parent_module"),
     f"SELECT {_E}, {_PARENT} FROM entities WHERE name = 'Brand#23' OR lower(qualified_name) LIKE '%::brand#23' ORDER BY t_ingested_at DESC, id DESC LIMIT 1", "entities")
_H = "id, priority, t_valid_from, t_valid_to"


def f06(t):
    first = t.history.orderBy("id").first()
    return lookup.entity_as_of(t.history, "customer", first["customer"], first["t_valid_from"]).select(*_H.split(", "))


both("F06_entity_as_of", f06, f""", f AS (SELECT customer, t_valid_from AS moment FROM history ORDER BY id LIMIT 1)
SELECT {_H} FROM history JOIN f USING (customer) WHERE t_valid_from <= moment AND (t_valid_to IS NULL OR t_valid_to > moment) ORDER BY t_valid_from DESC, id DESC LIMIT 1""", "history")
both("J05_as_of_join", lambda t: lookup.as_of_join(t.probes, t.history, "customer"),
     f"""SELECT p.customer, p.at, h.id, h.priority, h.t_valid_from, h.t_valid_to FROM probes p LEFT JOIN (SELECT p.customer, h.id, h.priority, h.t_valid_from, h.t_valid_to FROM probes p JOIN history h ON h.customer = p.customer
AND h.t_valid_from <= p.at AND (h.t_valid_to IS NULL OR h.t_valid_to > p.at) QUALIFY row_number() OVER (PARTITION BY p.customer ORDER BY h.t_valid_from DESC, h.id DESC) = 1) h ON h.customer = p.customer""", "probes", "history")  # fmt: skip
both("F07_conventions", lambda t: t.hot_signals.where("pattern = 'p:click'").orderBy("id"), "SELECT * FROM hot_signals WHERE pattern = 'p:click'", "hot_signals")
both("F08_relations_by_target", lambda t: lookup.relations_by(t.relations, "target_id", 10), "SELECT * FROM relations WHERE target_id = 10", "relations")
both("F09_query_symbol", lambda t: files.query_symbol(t.occurrences.select("symbol", "file_path", F.col("a").alias("start_line")), "CLICK#1"),
     "SELECT symbol, file_path, a AS start_line FROM occurrences WHERE lower(symbol) LIKE '%click#1%'", "occurrences")
both("F10_type_errors", lambda t: t.diagnostics.where(text.is_type_error(F.col("severity"), F.col("source"), F.col("code"))),
     "SELECT * FROM diagnostics WHERE severity = 1 AND (coalesce(source IN ('rust-analyzer', 'pyright', 'tsserver', 'typescript', 'mypy'), false) OR coalesce(regexp_matches(code, '^(E|TS2|TS7|report)'), false))", "diagnostics")
both("F13_status_gate", lambda t: t.chunks.join(t.source_status.where("status = 'available'"), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("n")),
     "SELECT source_id, count(*) AS n FROM chunks WHERE source_id IN (SELECT source_id FROM source_status WHERE status = 'available') GROUP BY ALL", "chunks", "source_status")
both("F14_chunk_kinds", lambda t: t.entities.where(F.col("kind").isin(*text.CHUNK_KINDS)).select("id", "kind"), "SELECT id, kind FROM entities WHERE kind IN ('function', 'method', 'class', 'struct', 'enum', 'trait', 'interface')", "entities")
both("J01_callers", lambda t: lookup.callers(t.entities, t.relations, t.entities.select(F.col("id").alias("target_id"))),
     """SELECT r.id AS edge_id, r.target_id, r.source_id, coalesce(s.qualified_name, s.name) AS caller, s.file_path, s.start_line FROM relations r JOIN entities e ON e.id = r.target_id JOIN entities s ON s.id = r.source_id WHERE r.kind = 'calls'""", "entities", "relations")  # fmt: skip
_J02 = """, s AS (SELECT source_id AS id, target_id AS peer_id, id AS edge_id, kind, 'out' AS direction FROM relations UNION ALL SELECT target_id, source_id, id, kind, 'in' FROM relations)
SELECT s.peer_id, s.id, s.edge_id, s.kind, s.direction, coalesce(p.qualified_name, p.name) AS peer, count(*) OVER w AS total, CAST(row_number() OVER (w ORDER BY s.kind, coalesce(p.qualified_name, p.name), s.edge_id) AS INT) AS n
FROM s JOIN entities e ON e.id = s.id JOIN entities p ON p.id = s.peer_id WINDOW w AS (PARTITION BY s.id, s.direction) QUALIFY n <= 5"""
both("J02_edges_capped", lambda t: lookup.edges_of(t.entities, t.relations, t.entities, 5), _J02, "entities", "relations")
both("J03_match_stored", lambda t: lookup.match_stored(t.entities.select("name", "start_line").distinct(), t.entities),
     "SELECT name, start_line, min(CASE WHEN start_line IS NOT NULL THEN id END) AS stored_id FROM entities GROUP BY ALL", "entities")
both("J04_session_dedup", lambda t: lookup.session_dedup(t.session_hits, t.session_files), "SELECT * FROM session_hits WHERE (session_id, file_path) NOT IN (SELECT session_id, file_path FROM session_files)", "session_hits", "session_files")
both("J06_edit_overlap", lambda t: lookup.edit_overlap(t.bonuses.select("bonus_id", "file_path", "line_lo", "line_hi"), t.edits),
     "SELECT bonus_id, file_path, line_lo, line_hi, EXISTS (SELECT 1 FROM edits e WHERE e.file_path = b.file_path AND greatest(line_lo, lo) <= least(line_hi, hi)) AS touched FROM bonuses b", "bonuses", "edits")


def _place(ident):
    """The SQL's order of text hits, made total: of those that it leaves equal the first row is the last hit, which is what arg_max keeps."""
    return (ident * 7 % 100003) * (1 << 40) - ident


def j08(t):
    s = t.entities.where("start_line IS NOT NULL").select(F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("name").alias("preview"), F.col("id").alias("pos"))
    x = t.entities.select(F.col("file_path").alias("file"), (F.col("end_line") - 5 + F.col("id") % 2).cast("int").alias("line"), F.col("signature").alias("preview"), _place(F.col("id")).alias("pos"))
    return lookup.merge_search(s, x, 1_000_000)


both("J08_merge_search", j08, """, s AS (SELECT file_path AS file, start_line AS line, name AS preview, 0 AS side, id AS pos FROM entities WHERE start_line IS NOT NULL),
x AS (SELECT file_path AS file, CAST(end_line - 5 + id % 2 AS INT) AS line, signature AS preview, 1 AS side, id * 7 % 100003 AS pos FROM entities), a AS (SELECT * FROM s UNION ALL SELECT * FROM x),
g AS (SELECT file, line, arg_min(preview, (side, pos)) AS first_preview, min(side) AS side, count(*) FILTER (side = 1) AS texts, arg_max(preview, pos) FILTER (side = 1) AS last_text FROM a GROUP BY ALL)
SELECT file, line, CASE WHEN side = 0 AND texts > 0 OR texts > 1 THEN 'both' WHEN side = 0 THEN 'symbol' ELSE 'text' END AS source, CASE WHEN side = 0 AND texts > 0 OR texts > 1 THEN last_text ELSE first_preview END AS preview FROM g""", "entities")


def j10(t):
    hits = t.session_hits.groupBy("file_path").agg(F.max("score").alias("score"))
    rows = {"conventions": t.issues.select(F.concat(F.lit("p/"), F.regexp_extract("file_path", r"(\d+)", 1), F.lit("/"), "category").alias("file_path"), F.col("message").alias("text")),
            "tests": t.chunks.select(F.col("path").alias("file_path"), F.col("source_id").alias("text"))}
    out = lookup.attach_bonuses(hits, rows)
    return out.select("file_path", "score", F.array_join("conventions", ",").alias("conventions"), F.array_join("tests", ",").alias("tests"))


both("J10_attach_bonuses", j10, """, h AS (SELECT file_path, max(score) AS score FROM session_hits GROUP BY ALL), c AS (SELECT 'p/' || regexp_extract(file_path, '(\\d+)', 1) || '/' || category AS file_path, string_agg(DISTINCT message, ',' ORDER BY message) AS v FROM issues GROUP BY ALL),
t AS (SELECT path AS file_path, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS v FROM chunks GROUP BY ALL)
SELECT file_path, score, CASE WHEN score >= 0.1 THEN c.v END AS conventions, CASE WHEN score >= 0.1 THEN t.v END AS tests FROM h LEFT JOIN c USING (file_path) LEFT JOIN t USING (file_path)""", "session_hits", "issues", "chunks")


def j11(t):
    r = t.occurrences.groupBy(F.col("symbol").alias("root")).agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("p"), F.col("role") % 3).alias("name"), F.col("file_path").alias("file"), F.col("b").alias("line")))).alias("peers"))
    r = r.withColumn("direction", F.when(F.col("root").startswith("click"), "incoming").when(F.col("root").startswith("view"), "outgoing").otherwise("supertypes"))
    return lookup.call_hierarchy(r)[1]


both("J11_call_hierarchy", j11, """, p AS (SELECT DISTINCT symbol AS root, file_path || '::p' || CAST(role % 3 AS STRING) || '@' || CAST(b AS STRING) AS key FROM occurrences)
SELECT CASE WHEN starts_with(root, 'click') THEN key ELSE root END AS source, CASE WHEN starts_with(root, 'click') THEN root ELSE key END AS target, CASE WHEN starts_with(root, 'click') OR starts_with(root, 'view') THEN 'calls' ELSE 'inherits' END AS kind FROM p""", "occurrences")
both("J13_file_entities", lambda t: lookup.file_entities(t.entities, *t.entities.agg(F.min("file_path"), F.max("file_path")).first()).select(*_COLS),
     f"SELECT {_E} FROM entities WHERE file_path IN ((SELECT min(file_path) FROM entities), (SELECT max(file_path) FROM entities))", "entities")


def d01(t):
    base = t.entities.select("id", "qualified_name", "file_path", F.col("t_ingested_at").alias("t_valid_from"), "signature", F.lit(0).cast("bigint").alias("t_last_verified"), F.lit(1).cast("bigint").alias("access_count"))
    current = base.where("id <= 1500").groupBy("qualified_name", "file_path", "t_valid_from").agg(F.min("id").alias("id"), F.min_by("signature", "id").alias("signature"), F.first("t_last_verified").alias("t_last_verified"), F.first("access_count").alias("access_count")).select(*base.columns)
    return snapshots.upsert_entities(current, base.withColumn("id", F.col("id") + 1000000), F.lit(99).cast("bigint"))


_B = "SELECT id, qualified_name, file_path, t_ingested_at AS t_valid_from, signature FROM entities"
both("D01_upsert_entities", d01, f""", b AS ({_B}), c AS (SELECT qualified_name, file_path, t_valid_from, min(id) AS id, arg_min(signature, id) AS signature FROM b WHERE id <= 1500 GROUP BY ALL),
n AS (SELECT qualified_name, file_path, t_valid_from, min(id) + 1000000 AS id, arg_min(signature, id) AS signature, count(*) AS k FROM b GROUP BY ALL)
SELECT coalesce(c.id, n.id) AS id, qualified_name, file_path, t_valid_from, coalesce(c.signature, n.signature) AS signature, CAST(99 AS BIGINT) AS t_last_verified, CAST(CASE WHEN c.id IS NULL THEN n.k ELSE 1 + n.k END AS BIGINT) AS access_count
FROM n LEFT JOIN c USING (qualified_name, file_path, t_valid_from)""", "entities")

_KEY = ["file_path", "line_start", "category", "severity", "message"]


def _issue_state(t):
    return t.issue_table.groupBy(*_KEY).agg(F.min("id").alias("id"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.bool_and("resolved").alias("resolved"))


_IS = "SELECT file_path, line_start, category, severity, message, min(id) AS id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, bool_and(resolved) AS resolved FROM issue_table GROUP BY file_path, line_start, category, severity, message"
both("D05_merge_diagnostics", lambda t: snapshots.merge_diagnostics(_issue_state(t), t.report, t.reported_files, 500),
     f""", c AS ({_IS}) SELECT coalesce(c.file_path, n.file_path) AS file_path, coalesce(c.line_start, n.line_start) AS line_start, coalesce(c.category, n.category) AS category, coalesce(c.severity, n.severity) AS severity,
coalesce(c.message, n.message) AS message, c.id, CAST(coalesce(c.first_seen, 500) AS INT) AS first_seen, CAST(CASE WHEN n.file_path IS NOT NULL THEN 500 ELSE c.last_seen END AS INT) AS last_seen,
CASE WHEN n.file_path IS NOT NULL THEN false WHEN f.file_path IS NOT NULL THEN true ELSE c.resolved END AS resolved
FROM c FULL JOIN report n ON c.file_path = n.file_path AND c.line_start IS NOT DISTINCT FROM n.line_start AND c.category = n.category AND c.severity = n.severity AND c.message = n.message
LEFT JOIN reported_files f ON f.file_path = coalesce(c.file_path, n.file_path)""", "issue_table", "report", "reported_files")  # fmt: skip
both("D06_purge_resolved", lambda t: snapshots.purge_resolved(t.issue_table, 45), "SELECT * FROM issue_table WHERE NOT (resolved AND last_seen < 45)", "issue_table")
both("D10_mark_promoted", lambda t: snapshots.mark_promoted(t.hot_signals.withColumn("promoted", F.lit(False)), t.hot_decisions.where("affected_files IS NULL").select("id")),
     "SELECT *, id IN (SELECT id FROM hot_decisions WHERE affected_files IS NULL) AS promoted FROM hot_signals", "hot_signals", "hot_decisions")

both("S01_walk_filter", lambda t: t.paths.where(paths.walk_keeps(F.col("path"))).select("id", "path"),
     "SELECT id, path FROM paths WHERE NOT (path LIKE 'target/%' OR path LIKE '.%' OR path LIKE '%/node_modules/%') AND regexp_matches(lower(path), '\\.(rs|py|ts|tsx|js|jsx|go|java|c|cpp|cc|h|hpp)$')", "paths")
_LANG = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '\\.({'|'.join(e)})$') THEN '{n}'" for n, e in paths.PARSER_LANGUAGES.items()) + " END"
both("S23_language_by_extension", lambda t: t.paths.select("id", paths.language(F.col("path")).alias("language")), f"SELECT id, {_LANG} AS language FROM paths", "paths")
both("S14_branch_folder", lambda t: t.paths.select("id", paths.branch_folder(F.col("path")).alias("folder")), "SELECT id, replace(path, '/', '-') AS folder FROM paths", "paths")
both("S22_detect_languages", lambda t: files.detect_languages(t.paths), """SELECT DISTINCT language FROM (SELECT CASE WHEN regexp_matches(lower(path), '\\.go$') THEN 'go' WHEN regexp_matches(lower(path), '\\.py$') THEN 'python'
WHEN regexp_matches(lower(path), '\\.rs$') THEN 'rust' WHEN regexp_matches(lower(path), '\\.tsx?$') THEN 'typescript' END AS language FROM paths WHERE NOT (path LIKE 'target/%' OR path LIKE '.%' OR path LIKE '%/node_modules/%')) WHERE language IS NOT NULL""", "paths")


def s16(t):
    rows = F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.lit("  "), F.col("line_no").cast("string"), F.lit(" "), "line").alias("row"))))["row"]
    body = t.lines.groupBy("doc_id").agg(F.array_join(rows, "\nnoise\n").alias("rows"))
    body = body.select(F.col("doc_id").alias("id"), F.concat(F.lit("7 stray\nFile: src/"), F.col("doc_id").cast("string"), F.lit(".rs\n"), "rows", F.lit("\n</result>\n8 stray\n")).alias("content"))
    return files.probe_hits(body, 1_000_000)


both("S16_probe_hits", s16, "SELECT doc_id AS id, 'src/' || doc_id || '.rs' AS file_path, line_no AS line, line AS snippet FROM lines", "lines")


def s15(t):
    body = F.concat(F.lit("worktree /w/"), "source", F.lit("\nHEAD "), F.md5("text"), F.lit("\nbranch refs/heads/"), "lang", F.lit("\n\nworktree /d\nHEAD "), F.sha2("text", 256), F.lit("\ndetached\n"))
    return files.worktrees(t.documents.select(F.col("doc_id").alias("id"), body.alias("content")))


both("S15_worktrees", s15, "SELECT doc_id AS id, '/w/' || source AS path, lang AS branch, md5(text) AS sha FROM documents UNION ALL SELECT doc_id, '/d', NULL, sha256(text) FROM documents")
