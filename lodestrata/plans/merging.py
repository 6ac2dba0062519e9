"""Fusion and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import dims
from lodestrata.operators import context, fusion, merge
from lodestrata.plans.fixtures import duck

QUERIES, ORACLE = {}, {}


def _case(column: str, table: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def _names(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


def a01(t):
    out = fusion.fuse_rrf(t.hits)
    return out.select("file_path", "start_line", "end_line", F.round("fused_score", 9).alias("fused_score"), _names("contributing"), "snippet")


QUERIES["A01_fuse_rrf"] = a01
_W = _case("source", dims.SEARCH_WEIGHTS, 0)
_O = _case("source", {s: k for k, s in enumerate(dims.SEARCH_WEIGHTS)}, 99)
ORACLE["A01_fuse_rrf"] = duck("hits") + f"""
SELECT file_path, start_line, end_line, round(sum(w / (60 + rank)), 9) AS fused_score, string_agg(source, ',' ORDER BY w DESC, o, rank) AS contributing, arg_min(snippet, (-w, o, rank)) AS snippet
FROM (SELECT *, CAST({_W} AS DOUBLE) AS w, {_O} AS o FROM hits) GROUP BY ALL"""


def a02(t):
    out = fusion.fuse_cross_group(t.group_hits, "understand_code")
    return out.select("file_path", "start_line", "end_line", F.round("fused_score", 9).alias("fused_score"), _names("contributing"), "snippet")


QUERIES["A02_fuse_cross_group"] = a02
_GW = _case("grp", dict(zip(dims.GROUPS, dims.GROUP_WEIGHTS["understand_code"], strict=True)), 0)
ORACLE["A02_fuse_cross_group"] = duck("group_hits") + f"""
SELECT file_path, start_line, end_line, round(sum(w / (60 + rank)), 9) AS fused_score, string_agg(grp, ',' ORDER BY w DESC, grp, rank) AS contributing, arg_min(snippet, (-w, grp, rank)) AS snippet
FROM (SELECT *, CAST({_GW} AS DOUBLE) AS w FROM group_hits WHERE status = 'available') GROUP BY file_path, start_line, end_line HAVING sum(w / (60 + rank)) <> 0"""

QUERIES["A03_group_weights"] = lambda t: t.spark.createDataFrame(fusion.group_weights(), "query_type string, grp string, weight double")
ORACLE["A03_group_weights"] = "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{g}', CAST({w} AS DOUBLE))" for q, g, w in fusion.group_weights()) + ") AS v(query_type, grp, weight)"

QUERIES["A04_fuse_fields"] = lambda t: fusion.fuse_fields(t.fields)[0]
_FA = _case("source", dims.FIELD_AUTHORITY, 99)
ORACLE["A04_fuse_fields"] = duck("fields") + f"SELECT file_path, start_line, end_line, field, arg_min(value, ({_FA}, pos)) AS value, arg_min(source, ({_FA}, pos)) AS source FROM fields GROUP BY ALL"

QUERIES["A04_field_conflicts"] = lambda t: fusion.fuse_fields(t.fields)[1]
ORACLE["A04_field_conflicts"] = duck("fields") + f"""
SELECT f.file_path, f.start_line, f.end_line, f.field, f.source, f.value, f.pos FROM fields f
JOIN (SELECT file_path, start_line, end_line, field, arg_min(value, ({_FA}, pos)) AS won FROM fields GROUP BY ALL) w USING (file_path, start_line, end_line, field) WHERE f.value IS DISTINCT FROM w.won"""

QUERIES["A05_merge_facts"] = lambda t: merge.merge_facts(t.facts)
ORACLE["A05_merge_facts"] = duck("facts") + """, per AS (SELECT entity, fact, arg_min({'c': confidence, 'o': observed, 's': source_id}, (-confidence, -observed, source_id)) AS v, count(*) AS agreement_count FROM facts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v.o DESC, v.c DESC, v.s, fact) AS k, count(*) OVER (PARTITION BY entity) - 1 AS conflict_count FROM per)
SELECT entity, fact, v.c AS confidence, v.o AS observed, v.s AS source_id, agreement_count, conflict_count FROM r WHERE k = 1"""

QUERIES["A06_union_edges"] = lambda t: merge.union_edges(t.edges)
_A06 = """SELECT source, target, edge_kind, arg_min(origin, pos) AS origin, arg_min(source_id, pos) AS source_id, max(coupling) AS coupling, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS contributors, min(pos) AS pos FROM edges GROUP BY ALL"""
ORACLE["A06_union_edges"] = duck("edges") + _A06

QUERIES["L04_strongest_edges"] = lambda t: merge.union_edges(t.edges, 1024)
ORACLE["L04_strongest_edges"] = duck("edges") + f"SELECT * FROM ({_A06}) ORDER BY coupling DESC, source, target, pos LIMIT 1024"

QUERIES["Z10_prefer_ground_truth"] = lambda t: merge.prefer_origin(t.edges)
ORACLE["Z10_prefer_ground_truth"] = duck("edges") + """
SELECT source, target, edge_kind, arg_min(origin, (CASE origin WHEN 'ground_truth' THEN 0 ELSE 1 END, pos)) AS origin, arg_min(source_id, (CASE origin WHEN 'ground_truth' THEN 0 ELSE 1 END, pos)) AS source_id, max(coupling) AS coupling FROM edges GROUP BY ALL"""

QUERIES["A07_assemble_context"] = lambda t: merge.assemble_context(t.chunks, t.source_status, t.context_files)
_A07 = "SELECT c.* FROM chunks c WHERE source_id IN (SELECT source_id FROM source_status WHERE status = 'available') AND path NOT IN (SELECT path FROM context_files)"
ORACLE["A07_assemble_context"] = duck("chunks", "source_status", "context_files") + _A07

QUERIES["A07_context_counters"] = lambda t: merge.context_counters(merge.assemble_context(t.chunks, t.source_status, t.context_files))
ORACLE["A07_context_counters"] = duck("chunks", "source_status", "context_files") + f"SELECT count(*) AS n_chunks, count(DISTINCT source_id) AS n_sources, CAST(least(sum(coalesce(tokens, 0)), 4294967295) AS BIGINT) AS token_sum FROM ({_A07})"

QUERIES["A08_merge_issues"] = lambda t: merge.merge_issues(t.issues).drop("ord")
_S = _case("severity", {s: k for k, s in enumerate(dims.SEVERITIES)}, 99)
ORACLE["A08_merge_issues"] = duck("issues") + f"""
SELECT file_path, line_start, category, arg_min(message, (s, source_tool, pos)) AS message, string_agg(DISTINCT source_tool, ',' ORDER BY source_tool) AS tools,
  coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id), '') AS rules, coalesce(string_agg(DISTINCT fix, ',' ORDER BY fix), '') AS fixes,
  CASE min(s) {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(dims.SEVERITIES))} END AS severity
FROM (SELECT *, {_S} AS s FROM issues) GROUP BY ALL"""

QUERIES["A09_merge_tests"] = lambda t: merge.merge_tests(t.tests)
ORACLE["A09_merge_tests"] = duck("tests") + """
SELECT test_path, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, max(confidence) AS confidence, coalesce(string_agg(DISTINCT source_path, ',' ORDER BY source_path), '') AS sources FROM tests GROUP BY ALL"""

QUERIES["A10_merge_tiers"] = lambda t: merge.merge_tiers(t.tiered)
_T = _case("tier", {s: k for k, s in enumerate(dims.TIERS)}, 99)
ORACLE["A10_merge_tiers"] = duck("tiered") + f"""
SELECT value, arg_min(tier, (-observed_at, o, pos)) AS source_tier, arg_min(confidence, (-observed_at, o, pos)) AS confidence, max(observed_at) AS observed_at,
  array_to_string(list_transform(list_sort(list(DISTINCT o)), lambda x: ['hot', 'warm', 'cold'][x + 1]), ',') AS tiers, min(pos) AS first_pos FROM (SELECT *, {_T} AS o FROM tiered) GROUP BY ALL"""

QUERIES["A11_resolve_conflicts"] = lambda t: fusion.resolve_conflicts(t.candidates)
_R = _case("authority", {s: k for k, s in enumerate(dims.FACT_AUTHORITY)}, 99)
ORACLE["A11_resolve_conflicts"] = duck("candidates") + f""", c AS (SELECT *, {_R} AS r FROM candidates), b AS (SELECT *, min(r) OVER (PARTITION BY key) AS best FROM c),
g AS (SELECT key, count(*) AS n, count(DISTINCT value) FILTER (r = best) = 1 AS ok, min(best) AS best, arg_min(value, (-confidence, pos)) FILTER (r = best) AS v, arg_min(confidence, (-confidence, pos)) FILTER (r = best) AS cf FROM b GROUP BY key),
h AS (SELECT *, ['lsp_ast', 'scip', 'kg', 'text'][best + 1] AS a FROM g)
SELECT key, ok AS resolved, CASE WHEN ok THEN v END AS value, CASE WHEN ok THEN cf END AS confidence, CASE WHEN ok THEN a END AS authority, CASE WHEN NOT ok THEN 'tied at tier ' || a END AS reason, CAST(CASE WHEN ok THEN 0 ELSE n END AS BIGINT) AS candidates FROM h"""

QUERIES["A22_degraded_groups"] = lambda t: fusion.degraded_groups(t.group_hits.select("grp", "status"))
ORACLE["A22_degraded_groups"] = duck("group_hits") + "SELECT coalesce(string_agg(DISTINCT grp, ',' ORDER BY grp) FILTER (status <> 'available'), '') AS degraded FROM group_hits"


def l08(t):
    i = t.issues.select(F.col("severity"), F.col("category").alias("source_group"), F.col("file_path").alias("file"), "pos")
    return merge.rank_findings(i)


QUERIES["L08_rank_findings"] = l08
ORACLE["L08_rank_findings"] = duck("issues") + f"""
SELECT severity, category AS source_group, file_path AS file, pos, CAST(row_number() OVER (ORDER BY {_S}, category, file_path, pos) AS BIGINT) AS place FROM issues"""


def u05(t):
    blast = t.small_edges.select(F.lit("blast").alias("source_group"), F.lit("medium").alias("severity"), F.col("target").alias("file"))
    issues = merge.merge_issues(t.issues).select(F.lit("quality").alias("source_group"), "severity", F.col("file_path").alias("file"))
    return blast.unionByName(issues).groupBy("source_group", "severity").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


QUERIES["U05_findings_union"] = u05
ORACLE["U05_findings_union"] = duck("small_edges", "issues") + f""", q AS (SELECT file_path, CASE min({_S}) {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(dims.SEVERITIES))} END AS severity FROM issues GROUP BY file_path, line_start, category)
SELECT source_group, severity, count(*) AS n, count(DISTINCT file) AS files FROM (SELECT 'blast' AS source_group, 'medium' AS severity, target AS file FROM small_edges UNION ALL SELECT 'quality', severity, file_path FROM q) GROUP BY ALL"""


def z01(t):
    h = t.facts.select(F.col("entity").cast("string").alias("file_path"), (F.col("observed") / 1000 % 200).cast("int").alias("start_line"), "observed", "confidence", "source_id", "fact").groupBy("file_path", "start_line").agg(F.min("observed").alias("rank"))
    return context.drop_overlaps(h.withColumn("end_line", F.col("start_line") + 9))


QUERIES["Z01_drop_overlaps"] = z01
ORACLE["Z01_drop_overlaps"] = duck("facts").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, h AS (SELECT CAST(entity AS STRING) AS file_path, CAST(observed / 1000 % 200 AS INT) AS start_line, min(observed) AS rank, CAST(observed / 1000 % 200 AS INT) + 9 AS end_line FROM facts GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank, start_line) AS n FROM h),
f(file_path, n, kept) AS (SELECT DISTINCT file_path, CAST(0 AS BIGINT), CAST([] AS STRUCT(s INT, e INT, r BIGINT)[]) FROM o UNION ALL SELECT f.file_path, o.n,
  CASE WHEN len(list_filter(f.kept, lambda k: (least(o.end_line, k.e) - greatest(o.start_line, k.s) + 1) / (greatest(o.end_line, k.e) - least(o.start_line, k.s) + 1) > 0.7)) = 0 THEN list_append(f.kept, {'s': o.start_line, 'e': o.end_line, 'r': o.rank}) ELSE f.kept END
  FROM f JOIN o ON o.file_path = f.file_path AND o.n = f.n + 1),
l AS (SELECT file_path, unnest(kept) AS k FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY n DESC) = 1))
SELECT file_path, k.s AS start_line, k.e AS end_line, k.r AS rank FROM l"""

QUERIES["W01_implicit_rank"] = lambda t: t.hits.select("source", "rank", "file_path", "start_line")
ORACLE["W01_implicit_rank"] = duck("hits") + "SELECT source, rank, file_path, start_line FROM hits"
