"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading
it back, so a lost executor costs a re-read, never a lost block.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.session import shared_root, stored

SMALL_ROWS = 50_000


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/lodestrata/{label}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; removed when the application ends."""
    return stored(df, label)


def near(small: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint for a materialised table of at most so many ``rows``; beyond that the join is shuffled."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def sampled(rows: DataFrame, at: Column, total: int, bound: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, by their hash ``at``: all rows of a hash or none.

    The hash is compared to 62 bits, so that no share is rounded to nothing however long
    the table. Where few values repeat so often that none was drawn, the share is taken of
    the values instead; a sample of rows that is empty then is an error.
    """
    if total <= bound:
        return rows
    # the low bits first: a share of 2^-20 or more draws what those bits alone would
    spread = F.shiftleft(at.bitwiseAND((1 << 20) - 1), 42).bitwiseOR(F.shiftrightunsigned(at, 20).bitwiseAND((1 << 42) - 1))
    drawn = rows.where(spread < int(bound / total * (1 << 62)))
    if not drawn.isEmpty():
        return drawn
    values = rows.agg(F.approx_count_distinct(at)).first()[0]
    drawn = rows.where(spread < int(min(1.0, bound / max(1, values)) * (1 << 62)))
    if drawn.isEmpty():
        raise ValueError(f"no row was drawn of {total}")
    return drawn


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``number``, from 0, among those that are equal in the (non-null) ``key`` columns.

    Repeated rows are numbered within their partition, then on from the counts of the
    partitions before, so that no task holds all repeats of a row. Rows that don't repeat
    aren't shuffled where the repeated keys are few.
    """
    repeats = rows.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1").drop("times")
    if repeats.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("bigint"))
    repeats = near(table(repeats, "repeats"))
    many = rows.join(repeats, list(key), "left_semi").withColumn("part", F.spark_partition_id())
    many = table(many.withColumn("number", F.row_number().over(Window.partitionBy(*key, "part").orderBy("part")) - 1), "repeated")
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = many.groupBy(*key, "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    many = many.join(counts.drop("n"), [*key, "part"]).withColumn("number", F.col("number") + F.col("before")).drop("part", "before")
    single = rows.join(repeats, list(key), "left_anti").withColumn("number", F.lit(0).cast("bigint"))
    return single.unionByName(many.select(*single.columns))


def dealt(spark: SparkSession, shard: str, shards: int) -> Column:
    """A number for each ``shard`` that hash partitioning into ``shards`` puts apart, for up to 4,096 of them."""
    if shards > 4096:
        return F.col(shard)
    tries = spark.range(shards * 20).select(F.col("id").cast("int").alias("v"))
    found = {r["p"]: r["v"] for r in tries.groupBy(F.pmod(F.hash("v"), F.lit(shards)).alias("p")).agg(F.min("v").alias("v")).collect()}
    return F.element_at(F.array(*[F.lit(found.get(k, -1 - k)) for k in range(shards)]), F.col(shard) + 1)


def shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by place, so that working columns can't clash with them."""
    return docs.toDF(*[f"in_{k}" for k in range(len(docs.columns))])


def place(docs: DataFrame, column: str) -> str:
    """The name that ``column`` has in ``shielded(docs)``."""
    return f"in_{[c.lower() for c in docs.columns].index(column.lower())}"


def unshielded(docs: DataFrame, names: list[str], *added: str) -> DataFrame:
    """The shielded columns under their own ``names``, and those ``added``, which replace equally named ones."""
    made = {a.lower() for a in added}
    return docs.select(*[docs[f"in_{k}"].alias(c) for k, c in enumerate(names) if c.lower() not in made], *added)
