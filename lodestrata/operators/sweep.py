"""Sweeps over sorted rows that no single key can hold up.

Rows of all keys are range-sorted together, so a key with a third of the rows lies in many
partitions. Each partition is swept alone; what a partition leaves open for a key that goes
on is a small summary, which is brought to the later partitions of that key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stored


def dealt(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` range-sorted, stored, and marked with their partition ``_part`` and their place ``_at`` in the whole order."""
    return stored(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sweep")


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` among a key's rows up to their own in ``order``, which must be total up to equal values.

    Two windows over (key, partition), so that no task holds a key's rows; the maxima of a
    key's earlier partitions are a row a key and partition.
    """
    kept = dealt(rows, *keys, *order)
    own = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    here = kept.withColumn(name, F.max(value).over(own))
    tops = kept.groupBy(*keys, "_part").agg(F.max(value).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.where(F.col("_before").isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_in"), "_before")
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = here.join(before, same, "left").withColumn(name, F.greatest(name, "_before"))
    return out.drop(*[f"_{k}" for k in keys], "_in", "_before", "_part", "_at")


def touched(asked: DataFrame, ranges: DataFrame, keys: list[str], ident: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The ``ident`` of rows of ``asked(ident, keys, lo, hi)`` that some range of ``ranges(keys, lo, hi)`` with their keys overlaps, ends included.

    Of the ranges that start no later than a row ends the one that reaches farthest
    decides, so the cost is one sort, whatever the number of overlaps. Ranges that end
    before they start, and null keys or ends, overlap nothing.
    """
    sound = (F.col(lo) <= F.col(hi)) & ~F.concat(*[F.col(k).cast("string") for k in keys]).isNull()
    r = ranges.where(sound).select(*keys, F.col(lo).cast("bigint").alias("_x"), F.lit(0).alias("_kind"), F.col(hi).cast("bigint").alias("_reach"), F.lit(None).cast("bigint").alias("_from")).distinct()
    r = r.withColumn("_id", F.lit(None).cast(asked.schema[ident].dataType))
    a = asked.where(sound).select(*keys, F.col(hi).cast("bigint").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_reach"), F.col(lo).cast("bigint").alias("_from"), F.col(ident).alias("_id"))
    swept = running_max(r.unionByName(a), keys, ["_x", "_kind"], "_reach", "_far")
    return swept.where((F.col("_kind") == 1) & (F.col("_far") >= F.col("_from"))).select(F.col("_id").alias(ident)).distinct()


def stabbed(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """For ``probes(key, at, probe)`` the version of ``versions(key, since, until, version)`` that is valid then: ``(probe, version)``.

    Valid are versions with since <= at < until, an ``until`` of null being open; of those
    the last to start, then the greatest ``version``. Versions may nest and overlap. ``at``,
    ``since`` and ``until`` are numbers, ``probe`` and ``version`` unique numbers. Probes
    without a valid version give no row.

    A partition keeps the versions that may still be an answer: each outlasts all that
    started after it. What it keeps at its end goes to the later partitions of that key.
    """
    versions = versions.where("key IS NOT NULL AND since IS NOT NULL AND (until IS NULL OR until > since)")
    rows = versions.select("key", F.col("since").alias("x"), F.lit(0).alias("kind"), F.col("version").alias("n"), "until", F.col("since").alias("since"))
    rows = rows.unionByName(probes.where("key IS NOT NULL AND at IS NOT NULL").select("key", F.col("at").alias("x"), F.lit(1).alias("kind"), F.col("probe").alias("n"), F.lit(None).cast("bigint").alias("until"), F.lit(None).cast("bigint").alias("since")))
    kept = dealt(rows, "key", "x", "kind", "n")
    kind = kept.schema["key"].dataType.simpleString()
    # keys that go on into another partition, and what each partition leaves open for them
    spans = kept.groupBy("key", "_part").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("parts"), F.collect_set("_part").alias("in")).where("parts > 1")
    spans = stored(spans.select("key", "in"), "spans")
    first = kept.join(spans.select("key"), "key", "left_semi").where("kind = 0").repartition("key", "_part").sortWithinPartitions("key", "_part", "_at")
    left = first.select("key", "_part", "x", "n", "until").mapInArrow(_left_open, f"key {kind}, _part int, x bigint, n bigint, until bigint")
    later = left.join(spans, "key").select("key", F.explode("in").alias("_to"), "_part", "x", "n", "until").where("_to > _part")
    later = later.select("key", F.col("_to").alias("_part"), "x", F.lit(0).alias("kind"), "n", "until", F.lit(0).alias("_own"))
    both = kept.select("key", "_part", "x", "kind", "n", "until", F.lit(1).alias("_own")).unionByName(later)
    swept = both.repartition("key", "_part").sortWithinPartitions("key", "_part", "_own", "x", "kind", "n")
    return swept.select("key", "_part", "x", "kind", "n", "until").mapInArrow(_stab, "probe bigint, version bigint")


def _groups(batches: Iterator) -> Iterator:
    """``(whether a new key and partition begins, the rest of the row)``."""
    now = None
    for b in batches:
        for key, part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield (key, part) != now, (key, part), row
            now = (key, part)


def _push(stack: list, n: int, until: int | None, since: int) -> None:
    """Versions that start no later and end no later than the new one can't be an answer any more."""
    end = float("inf") if until is None else until
    while stack and stack[-1][1] <= end:
        stack.pop()
    stack.append((n, end, since))


def _left_open(batches: Iterator) -> Iterator:
    import pyarrow as pa

    out, stack, now = [], [], None
    kinds = None

    def close() -> None:
        out.extend((*now, since, n, None if end == float("inf") else int(end)) for n, end, since in stack)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "_part", "x", "n", "until"])
        out.clear()
        return made

    for b in batches:
        kinds = kinds or b.schema.types
        for new, key, (x, n, until) in _groups([b]):
            if new and key != now:
                if now:
                    close()
                stack, now = [], key
            _push(stack, n, until, x)
        if len(out) > 10_000:
            yield batch()
    if now:
        close()
    if kinds:
        yield batch()


def _stab(batches: Iterator) -> Iterator:
    import pyarrow as pa

    stack, now = [], None
    for b in batches:
        probe, version = [], []
        for new, key, (x, kind, n, until) in _groups([b]):
            if new and key != now:
                stack, now = [], key
            if kind == 0:
                _push(stack, n, until, x)
                continue
            while stack and stack[-1][1] <= x:
                stack.pop()
            if stack:
                probe.append(n)
                version.append(stack[-1][0])
        yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int64()), pa.array(version, pa.int64())], names=["probe", "version"])
