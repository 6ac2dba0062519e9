"""Merges of many sources' observations, one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata import dims
from lodestrata.functions.paths import component_order, normalise
from lodestrata.operators.fusion import lookup
from lodestrata.operators.graph import numbered


def merge_facts(facts: DataFrame) -> DataFrame:
    """``(source_id, entity, fact, confidence, observed)`` to the winning fact per entity.

    Within a fact the most confident observation stands for it (then newest, then source);
    across facts the newest wins (then most confident, then source, then the smaller fact).
    Two stages, not one sort: a fact enters with its own best observation.
    """
    inner = F.struct(-F.col("confidence"), -F.col("observed"), F.col("source_id"))
    per = facts.groupBy("entity", "fact").agg(
        F.min(inner).alias("b"), F.count("*").alias("agreement"), F.min_by(F.struct("confidence", "observed", "source_id"), inner).alias("v")
    )
    outer = F.struct(-F.col("v.observed"), -F.col("v.confidence"), F.col("v.source_id"), F.col("fact"))
    out = per.groupBy("entity").agg(F.min_by(F.struct("fact", "v", "agreement"), outer).alias("w"), (F.count("*") - 1).alias("conflict_count"))
    return out.select(
        "entity",
        F.col("w.fact").alias("fact"),
        F.col("w.v.confidence").alias("confidence"),
        F.col("w.v.observed").alias("observed"),
        F.col("w.v.source_id").alias("source_id"),
        F.col("w.agreement").alias("agreement_count"),
        "conflict_count",
    )


def union_edges(edges: DataFrame, max_edges: int | None = None) -> DataFrame:
    """``(source, target, edge_kind, source_id, origin, coupling, pos)`` with one row per (source, target, kind).

    The first edge gives origin and source, the largest coupling counts, contributors are
    distinct and sorted. With ``max_edges`` the strongest are kept.
    """
    out = edges.groupBy("source", "target", "edge_kind").agg(
        F.min_by("origin", "pos").alias("origin"),
        F.min_by("source_id", "pos").alias("source_id"),
        F.max("coupling").alias("coupling"),
        F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("contributors"),
        F.min("pos").alias("pos"),
    )
    if max_edges is not None:
        out = out.orderBy(F.desc("coupling"), "source", "target", "pos").limit(max_edges)
    return out


def prefer_origin(edges: DataFrame) -> DataFrame:
    """As union_edges, but ground truth outranks inference when origin and source are chosen."""
    rank = F.struct(F.when(F.col("origin") == "ground_truth", 0).otherwise(1), F.col("pos"))
    return edges.groupBy("source", "target", "edge_kind").agg(
        F.min_by("origin", rank).alias("origin"), F.min_by("source_id", rank).alias("source_id"), F.max("coupling").alias("coupling")
    )


def assemble_context(chunks: DataFrame, status: DataFrame, in_context: DataFrame) -> DataFrame:
    """``(source_id, path, pagerank, tokens)`` of available sources, without paths already in context."""
    live = chunks.join(status.where("status = 'available'").select("source_id").distinct(), "source_id", "left_semi")
    have = in_context.select(normalise(F.col("path")).alias("_have")).distinct()
    return live.join(have, normalise(F.col("path")) == F.col("_have"), "left_anti")


def context_counters(chunks: DataFrame) -> DataFrame:
    """Totals of an assembled context; missing token counts are zero and the sum saturates at 32 bits."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct("source_id").alias("n_sources"),
        F.least(F.sum(F.coalesce("tokens", F.lit(0)).cast("bigint")), F.lit((1 << 32) - 1)).alias("token_sum"),
    )


def merge_issues(issues: DataFrame) -> DataFrame:
    """``(source_tool, file_path, line_start, category, severity, message, rule_id, fix, pos)`` by place and category."""
    rank = lookup(F.col("severity"), {s: k for k, s in enumerate(dims.SEVERITIES)}, 99)
    names = F.array(*map(F.lit, dims.SEVERITIES))
    out = issues.withColumn("_s", rank).groupBy("file_path", "line_start", "category").agg(
        F.min("_s").alias("ord"),
        F.min_by("message", F.struct("_s", "source_tool", "pos")).alias("message"),
        *[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(a) for c, a in (("source_tool", "tools"), ("rule_id", "rules"), ("fix", "fixes"))],
    )
    return out.withColumn("severity", F.element_at(names, (F.col("ord") + 1).cast("int")))


def issue_order() -> list:
    return [F.asc("ord"), component_order("file_path").asc(), F.col("line_start").asc_nulls_last(), F.asc("category")]


def merge_tests(candidates: DataFrame) -> DataFrame:
    """``(test_path, source_path, method, confidence)`` by test: methods in fixed order, best confidence, sorted sources."""
    rank = lookup(F.col("method"), {m: k for k, m in enumerate(dims.TEST_METHODS)}, 99)
    found = F.array_sort(F.collect_set(F.struct(rank.alias("o"), F.col("method").alias("m"))))
    return candidates.groupBy("test_path").agg(
        F.array_join(F.transform(found, lambda x: x["m"]), ",").alias("methods"),
        F.max("confidence").alias("confidence"),
        F.array_join(F.array_sort(F.collect_set("source_path")), ",").alias("sources"),
    )


def merge_tiers(rows: DataFrame) -> DataFrame:
    """``(value, tier, confidence, observed_at, pos)`` by value: the newest observation wins, the hotter tier in a tie."""
    rank = lookup(F.col("tier"), {t: k for k, t in enumerate(dims.TIERS)}, 99)
    at = F.struct(-F.col("observed_at"), F.col("_t"), F.col("pos"))
    seen = F.array_sort(F.collect_set(F.struct(F.col("_t").alias("o"), F.col("tier").alias("t"))))
    return rows.withColumn("_t", rank).groupBy("value").agg(
        F.min_by("tier", at).alias("source_tier"),
        F.min_by("confidence", at).alias("confidence"),
        F.max("observed_at").alias("observed_at"),
        F.array_join(F.transform(seen, lambda x: x["t"]), ",").alias("tiers"),
        F.min("pos").alias("first_pos"),
    )


def rank_findings(findings: DataFrame) -> DataFrame:
    """Findings numbered by severity, source group and file; position breaks ties."""
    weight = lookup(F.col("severity"), {s: 4 - k for k, s in enumerate(dims.SEVERITIES)}, -1)
    return numbered(findings.withColumn("_w", weight), [F.desc("_w"), F.asc("source_group"), F.asc("file"), F.asc("pos")], "place").drop("_w")
