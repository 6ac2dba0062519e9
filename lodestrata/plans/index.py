"""Ingestion and the incremental chunk index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import parsing, text
from lodestrata.operators import lookup, snapshots, vector
from lodestrata.operators.graph import numbered
from lodestrata.sources import files


def ingest(spark: SparkSession, root: str, entities: snapshots.VersionedTable, schema: str, now) -> int:
    """Parses the tree's files and upserts their symbols; returns how many rows the table has."""
    source = files.walk_sources(spark, root).select(F.col("relative").alias("path"), "language", "content")
    new = parsing.to_entities(parsing.extract_symbols(source)).dropDuplicates(["qualified_name", "file_path"])
    known = entities.read(schema)
    first = known.agg(F.max("id")).first()[0] or 0
    new = numbered(new, [F.asc("file_path"), F.asc("qualified_name")], "n").withColumn("id", F.col("n") + first).drop("n")
    new = new.withColumns({"t_ingested_at": F.lit(now), "t_last_verified": F.lit(now), "access_count": F.lit(0).cast("bigint")})
    entities.commit(snapshots.upsert_entities(known, new.select(*known.columns), F.lit(now)))
    return entities.read().count()


def index_paths(source: DataFrame, state: DataFrame, embed: Callable[[Column], Column], dim: int, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(path, language, content, mtime)`` to new chunk rows, the next state, and counters.

    Files whose modification second is unchanged are skipped. ``embed`` maps a content
    column to a vector column; a chunk without a vector counts as failed, one of another
    length raises when the rows are written. Old rows are never deleted: readers take the
    newest per id.
    """
    todo = vector.changed_files(source, state)
    chunks = parsing.chunk_symbols(todo, parsing.extract_symbols(todo)).join(todo.select("path", "language", F.sha2("content", 256).alias("file_hash")), "path")
    chunks = chunks.withColumn("embedding", embed(F.col("content"))).withColumn("indexed_at", F.lit(now))
    fits = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("dim_mismatch")).cast(chunks.schema["embedding"].dataType))
    rows = chunks.where("embedding IS NOT NULL").withColumn("embedding", fits)
    following = state.join(todo.select("path"), "path", "left_anti").unionByName(todo.select("path", "mtime"))
    scanned = source.agg(F.count("*").alias("scanned"))
    indexed = todo.agg(F.count("*").alias("indexed"))
    made = chunks.agg(F.count("embedding").alias("inserted"), F.count_if(F.col("embedding").isNull()).alias("failed"))
    stats = scanned.join(indexed).join(made).withColumn("skipped", F.col("scanned") - F.col("indexed"))  # one row each
    return rows, following, stats


def explain_symbol(entities: DataFrame, relations: DataFrame, qualified_name: str, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest entity of that name with its edge counts, and its capped edges both ways.

    An unknown name gives two empty tables; edges to peers that aren't stored don't count.
    The file that holds the entity is told by ``explain_files``.
    """
    found = lookup.entity_by_qualified_name(entities, qualified_name)
    edges = lookup.edges_of(entities, relations, found, cap)
    totals = edges.groupBy("id").agg(F.max(F.when(F.col("direction") == "in", F.col("total"))).alias("inbound"), F.max(F.when(F.col("direction") == "out", F.col("total"))).alias("outbound"))
    counts = [F.coalesce(c, F.lit(0)).alias(f"{c}_relation_count") for c in ("inbound", "outbound")]
    summary = found.join(totals, "id", "left").select(*found.columns, *counts)
    return summary, edges.drop("total").withColumnRenamed("n", "rank")


def explain_files(source: DataFrame, symbols: DataFrame, entities: DataFrame, cap: int = 100) -> DataFrame:
    """Per file: language, lines, imports, its first ``cap`` symbols in extraction order, stored entities."""
    top = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "name", "start_line"))).alias("all"))
    stored = entities.groupBy(F.col("file_path").alias("path")).agg(F.count_distinct("id").alias("stored"))
    out = source.join(top, "path", "left").join(stored, "path", "left")
    names = F.transform(F.slice(F.coalesce("all", F.expr("array()").cast("array<struct<pos:int,kind:string,name:string,start_line:int>>")), 1, cap), lambda x: F.concat(x["kind"], F.lit(" "), x["name"]))
    return out.select(
        "path", "language", F.size(text.lines(F.col("content"))).alias("line_count"), text.import_count(F.col("content"), F.col("language")).alias("imports"),
        F.array_join(names, ",").alias("symbols"), F.coalesce(F.size("all"), F.lit(0)).alias("symbol_total"), F.coalesce("stored", F.lit(0)).alias("stored"),
    )
