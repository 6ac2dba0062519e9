"""The query tools: each composes operators over tables and returns DataFrames.

Tables come in a mapping: entities, relations, conventions, edges, issues, tests,
chunks, diagnostics, findings inputs; a tool reads those it names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import context, fusion, graph, lookup, merge, snapshots, vector
from lodestrata.sources import files

Tables = Mapping[str, DataFrame]


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return default if value is None else min(high, max(low, value))


def direction_of(name: str | None) -> tuple[str, ...]:
    return (name,) if name in ("upstream", "downstream") else ("upstream", "downstream")


def find_definition(t: Tables, name: str, file_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The definition, and its callers in edge order."""
    found = lookup.resolve_symbol(t["entities"], name, file_path)
    return found, lookup.callers(t["entities"], t["relations"], found.select(F.col("id").alias("target_id"))).orderBy("edge_id")


def enrich_definition(found: DataFrame, hover: DataFrame | None) -> DataFrame:
    """Definitions with the text of ``hover(qualified_name, text)``, the least in a tie, or null; none is lost."""
    if hover is None:
        return found.withColumn("hover", F.lit(None).cast("string"))
    return found.join(hover.groupBy("qualified_name").agg(F.min("text").alias("hover")), "qualified_name", "left")


def find_references(t: Tables, name: str) -> DataFrame:
    """Relations into the symbol by kind, with the referring entity."""
    found = lookup.resolve_symbol(t["entities"], name).select(F.col("id").alias("target_id"))
    e = t["entities"].select(F.col("id").alias("source_id"), F.coalesce("qualified_name", "name").alias("referrer"))
    return t["relations"].join(found, "target_id", "left_semi").join(e, "source_id").select("kind", "id", "referrer")


def get_conventions(t: Tables, category: str | None = None) -> DataFrame:
    rows = t["conventions"]
    return (rows if category is None else rows.where(F.col("category") == category)).orderBy("id")


def search_code(t: Tables, query: str, limit: int | None = None) -> DataFrame:
    """Symbols by name first, then lines of the files that hold the query."""
    n = clamp(limit, 50, 1, 500)
    s = lookup.search_by_name(t["entities"], query, n)
    s = s.select(F.col("file_path").alias("file"), F.coalesce("start_line", F.lit(0)).cast("int").alias("line"), F.coalesce("qualified_name", "name").alias("preview"), (-F.coalesce("t_ingested_at", F.lit(0))).cast("bigint").alias("at"), (-F.col("id")).alias("id"))
    s = graph.numbered(s, [F.asc("at"), F.asc("id")], "pos").drop("at", "id")
    x = files.text_search(t["files"], query, n).select(F.col("path").alias("file"), F.col("line").cast("int").alias("line"), "preview")
    x = graph.numbered(x, [F.split("file", "/").asc(), F.asc("line")], "pos")
    return lookup.merge_search(s, x, n)


def find_similar(t: Tables, query: list[float], limit: int | None = None) -> DataFrame:
    return vector.find_similar(t["chunks"], query, clamp(limit, 10, 1, 100))


def get_architecture(t: Tables, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct modules, and the strongest merged edges between them."""
    edges = merge.union_edges(t["edges"], clamp(max_edges, 256, 1, 4096))
    return graph.modules(edges).orderBy("module"), edges.orderBy("source", "target")


def trace_dependencies(t: Tables, target: str, direction: str | None = None, max_depth: int | None = None, max_edges: int | None = None) -> DataFrame:
    """Nodes upstream and downstream of the target, by direction, depth and name."""
    edges = graph.cut(merge.union_edges(t["edges"], clamp(max_edges, 1024, 1, 4096)))
    seed = t["edges"].sparkSession.createDataFrame([(target,)], "node string")
    out = None
    for d in direction_of(direction):
        part = graph.directional_bfs(edges, seed, d, clamp(max_depth, 3, 1, 8)).withColumn("direction", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("direction", "depth", "node")


def blast_radius(t: Tables, seeds: list[str], max_depth: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Impacted nodes by strength, and the ten strongest chains back to a seed."""
    edges = merge.union_edges(t["edges"], clamp(max_edges, 1024, 1, 4096))
    at = t["edges"].sparkSession.createDataFrame([(s, k) for k, s in enumerate(seeds)], "node string, pos int")
    reached = graph.blast_radius(edges, at, clamp(max_depth, 3, 1, 8))
    return graph.impacted(reached), graph.dependency_chains(reached)


def check_quality(t: Tables) -> tuple[DataFrame, DataFrame]:
    return merge.merge_issues(t["issues"]).orderBy(*merge.issue_order()), merge.merge_tests(t["tests"]).orderBy(F.split("test_path", "/"))


def review_changes(t: Tables, changed: list[str]) -> DataFrame:
    """Blast radius of the changed files and the issues of the first of them, ranked together."""
    hit, _ = blast_radius(t, changed)
    blast = hit.select(F.lit("blast_radius").alias("source_group"), F.when(F.col("weight") >= 0.5, "high").otherwise("medium").alias("severity"), F.col("node").alias("file"), F.col("depth").cast("bigint").alias("pos"))
    issues = merge.merge_issues(t["issues"].where(F.col("file_path") == changed[0]))
    quality = issues.select(F.lit("quality").alias("source_group"), "severity", F.col("file_path").alias("file"), F.coalesce("line_start", F.lit(0)).cast("bigint").alias("pos"))
    return merge.rank_findings(blast.unionByName(quality))


def type_check(t: Tables, paths: list[str] | None = None) -> DataFrame:
    rows = t["diagnostics"].where(text.is_type_error(F.col("severity"), F.col("source"), F.col("code")))
    return rows if paths is None else rows.where(F.col("file_path").isin(*paths))


def remember(t: Tables, new: DataFrame) -> DataFrame:
    """The observation log with the new rows; ids go on from the largest."""
    return snapshots.appended(t["observations"], new)


def get_context_for_edit(t: Tables, in_context: DataFrame, budget: int = 8000) -> DataFrame:
    """Fused hits that aren't in context yet, above the threshold, as many as the budget holds."""
    fused = fusion.fuse_cross_group(t["hits"], "get_context_for_edit").withColumn("session_id", F.lit("")).withColumnRenamed("fused_score", "score")
    kept, _ = context.assemble_response(fused, in_context.withColumn("session_id", F.lit("")), 0.0)
    return graph.fit_to_budget(kept, "tokens", [F.desc("score"), F.split("file_path", "/"), F.asc("start_line"), F.asc("end_line")], budget).drop("session_id")
