"""Rank fusion, field fusion and conflict resolution.

Rank, position and source order are explicit columns. Small fixed tables (weights,
authorities) are ``when`` chains, so nothing is joined or broadcast for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import dims
from lodestrata.functions.paths import component_order

SPAN = ("file_path", "start_line", "end_line")


def lookup(key: Column, table: dict, default=0.0) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def fused_order(score: str = "fused_score") -> list[Column]:
    """Score descending, then path by component, then span."""
    return [F.desc(score), component_order("file_path").asc(), F.asc("start_line"), F.asc("end_line")]


def _fuse(hits: DataFrame, source: str, weight: Column, ordinal: Column) -> DataFrame:
    """One aggregation per span: score, sources by weight, and the best source's first snippet."""
    h = hits.withColumn("_w", weight).withColumn("_o", ordinal)
    best = F.struct(-F.col("_w"), F.col("_o"), F.col("rank"))
    score = F.aggregate(F.array_sort(F.collect_list(F.col("_w") / (dims.RRF_K + F.col("rank")))), F.lit(0.0), lambda a, x: a + x)
    return h.groupBy(*SPAN).agg(
        score.alias("fused_score"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_w")).alias("w"), F.col("_o").alias("o"), F.col("rank").alias("r"), F.col(source).alias("s")))), lambda x: x["s"]).alias("contributing"),
        F.min_by("snippet", best).alias("snippet"),
    )


def fuse_rrf(hits: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion of ``(source, rank, file_path, start_line, end_line, snippet)``."""
    order = {s: k for k, s in enumerate(dims.SEARCH_WEIGHTS)}
    return _fuse(hits, "source", lookup(F.col("source"), dims.SEARCH_WEIGHTS), lookup(F.col("source"), order, 99))


def group_weights() -> list[tuple[str, str, float]]:
    return [(q, g, w) for q, row in dims.GROUP_WEIGHTS.items() for g, w in zip(dims.GROUPS, row, strict=True)]


def fuse_cross_group(hits: DataFrame, query_type: str) -> DataFrame:
    """Fusion of ``(grp, status, rank, span, snippet)`` by the query type's group weights.

    Groups that aren't available or weigh nothing are filtered before the aggregation.
    """
    weights = dict(zip(dims.GROUPS, dims.GROUP_WEIGHTS[query_type], strict=True))
    used = [g for g, w in weights.items() if w]
    live = hits.where((F.col("status") == "available") & F.col("grp").isin(*used))
    return _fuse(live, "grp", lookup(F.col("grp"), weights), F.substring("grp", 2, 1).cast("int")).where("fused_score <> 0")


def degraded_groups(status: DataFrame) -> DataFrame:
    """``(grp, status)`` rows rolled up to the sorted names that aren't available."""
    return status.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "available", F.col("grp")))), ",").alias("degraded"))


def fuse_fields(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(source, pos, span, field, value)`` to the winning value per span and field, and the values that differ from it.

    The source with the least authority rank wins, the first of its entries in a tie.
    """
    e = entries.withColumn("_a", lookup(F.col("source"), dims.FIELD_AUTHORITY, 99))
    at = F.struct("_a", "pos")
    won = e.groupBy(*SPAN, "field").agg(F.min_by("value", at).alias("value"), F.min_by("source", at).alias("source"))
    w = Window.partitionBy(*SPAN, "field")
    marked = e.withColumn("_won", F.min_by("value", at).over(w))
    lost = marked.where(~F.col("value").eqNullSafe(F.col("_won"))).select(*SPAN, "field", "source", "value", "pos")
    return won, lost


def resolve_conflicts(candidates: DataFrame) -> DataFrame:
    """``(key, pos, value, authority, confidence)`` to one resolution a key.

    A single candidate is itself. Otherwise the best authority's candidates decide: if all
    agree the most confident (first in a tie) wins, else the key is unresolved.
    """
    rank = {a: k for k, a in enumerate(dims.FACT_AUTHORITY)}
    c = candidates.withColumn("_t", lookup(F.col("authority"), rank, 99))
    top = c.withColumn("_best", F.min("_t").over(Window.partitionBy("key")))
    in_top = F.col("_t") == F.col("_best")
    value = F.when(in_top, F.struct("value"))
    first = F.struct(-F.col("confidence"), F.col("pos"))
    out = top.groupBy("key").agg(
        F.count("*").alias("n"),
        F.count_distinct(value).alias("values"),
        F.min("_best").alias("tier"),
        F.min_by("value", F.when(in_top, first)).alias("value"),
        F.min_by("confidence", F.when(in_top, first)).alias("confidence"),
    )
    ok = F.col("values") == 1
    name = F.element_at(F.array(*map(F.lit, dims.FACT_AUTHORITY)), (F.col("tier") + 1).cast("int"))
    return out.select(
        "key",
        ok.alias("resolved"),
        F.when(ok, F.col("value")).alias("value"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        F.when(ok, name).alias("authority"),
        F.when(~ok, F.concat(F.lit("tied at tier "), name)).alias("reason"),
        F.when(ok, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("candidates"),
    )
