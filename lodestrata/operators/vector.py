"""Nearest neighbours over chunk embeddings, and the incremental chunk index."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class VectorError(ValueError):
    """A typed failure: dim_mismatch, table_not_found or embedding_failed."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length; a norm below the single-precision epsilon counts as that."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(2.0**-23)))


def check_dimension(n: int) -> int:
    if not 32 <= n <= 7168:
        raise VectorError("dim_mismatch", f"{n} is not within 32 to 7168")
    return n


def find_similar(chunks: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The ``k`` (1 to 100) nearest chunks by squared distance, ties by key, with ``similarity = 1 / (1 + distance)``.

    One scan, made at once: a vector of another length would come out first. Null vectors are no neighbours.
    """
    k = min(100, max(1, k))
    at = F.array(*[F.lit(float(x)) for x in query])
    wrong = F.size(vector) != len(query)
    near = chunks.where(F.col(vector).isNotNull()).withColumn("distance", F.when(~wrong, squared_distance(F.col(vector), at)))
    near = near.withColumn("similarity", 1 / (1 + F.col("distance"))).withColumn("_wrong", wrong)
    rows = near.orderBy(F.desc("_wrong"), "distance", key).limit(k).collect()  # at most 100
    if rows and rows[0]["_wrong"]:
        raise VectorError("dim_mismatch", f"the query has {len(query)} components")
    return chunks.sparkSession.createDataFrame(rows, near.schema).drop("_wrong")


def knn_join(queries: DataFrame, chunks: DataFrame, k: int = 10, vector: str = "embedding", key: str = "id", shard_bytes: int = 64 << 20, at_once: int = 256) -> DataFrame:
    """For each ``queries(query_id, v)`` its ``k`` nearest chunks, exact, ties by key.

    Chunks are dealt to shards of about ``shard_bytes``; every shard is sent the queries,
    multiplies ``at_once`` of them with its rows at a time and passes on its ``k`` best per
    query. A task holds one shard, whatever the numbers of rows and queries. The product form
    of the distance prunes with a slack that covers its rounding, the differences decide.
    Null vectors and those with null or non-finite components have and are no neighbours;
    vectors of several lengths are a ``dim_mismatch``.
    """
    own = chunks.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where("v IS NOT NULL").select(F.col("query_id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    size = lambda d: d.select(F.size("v").alias("d"))
    head = size(own).withColumn("c", F.lit(1)).unionByName(size(asked).withColumn("c", F.lit(0))).agg(F.sum("c").alias("n"), F.count("*").alias("all"), F.min("d").alias("low"), F.max("d").alias("dim")).first()
    if head["low"] != head["dim"]:
        raise VectorError("dim_mismatch", f"vectors have {head['low']} to {head['dim']} components")
    dim = max(head["dim"] or 1, 1)
    n, asks = head["n"] or 0, head["all"] - (head["n"] or 0)
    busy = min(chunks.sparkSession.sparkContext.defaultParallelism, n * asks * dim >> 28)  # little work needs few tasks
    shards = max(1, busy, math.ceil(n * dim * 8 / shard_bytes))
    dealt = own.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
    rows = dealt.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id")
    near = rows.mapInArrow(lambda batches: _nearest_in_shards(batches, k, dim, at_once), "query_id bigint, id bigint, distance double")
    return _top(near, k)


def _nearest_in_shards(batches: Iterator, k: int, dim: int, at_once: int) -> Iterator:
    """``(shard, asks, id, v)``, in each shard the chunks and then the queries, to the shard's ``k`` best per query."""
    import numpy as np
    import pyarrow as pa

    now, ids, parts, held = None, [], [], None
    for b in batches:
        shard, asks, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "id"))
        v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True):
            if lo == hi:
                continue
            if shard[lo] != now:
                now, ids, parts, held = shard[lo], [], [], None
            if not asks[lo]:
                fine = np.isfinite(v[lo:hi]).all(axis=1)
                ids.append(own[lo:hi][fine])
                parts.append(v[lo:hi][fine])
                continue
            if held is None:
                held = (np.concatenate(ids), np.concatenate(parts)) if ids else (np.empty(0, np.int64), np.empty((0, dim)))
                ids, parts = [], []
            for at in range(lo, hi, at_once):
                fine = np.isfinite(v[at : min(hi, at + at_once)]).all(axis=1)
                names, q = own[at : min(hi, at + at_once)][fine], v[at : min(hi, at + at_once)][fine]
                row, found, d = _nearest(q, *held, k)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(found), pa.array(d)], names=["query_id", "id", "distance"])


def _nearest(q, ids, x, k: int, width: int = 2048, most: int = 1 << 21):
    """The ``k`` rows of ``x`` nearest to each of ``q`` as flat (query row, id, squared distance)."""
    import numpy as np

    row, found, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    worst = np.full(len(q), np.inf)
    qq = (q * q).sum(axis=1)
    step = max(1, most // max(1, x.shape[1]))
    for lo in range(0, len(x), width):
        part = x[lo : lo + width]
        xx = (part * part).sum(axis=1)
        about = qq[:, None] + xx[None] - 2 * (q @ part.T)
        slack = 1e-15 * (8 + x.shape[1]) * (qq + xx.max(initial=0.0))
        bound = worst + slack
        if len(part) > k:
            bound = np.minimum(bound, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * slack)
        at, col = np.nonzero(about <= bound[:, None])
        exact = np.concatenate([((q[at[s : s + step]] - part[col[s : s + step]]) ** 2).sum(axis=1) for s in range(0, len(at), step)] or [np.empty(0)])
        row, found, d = np.concatenate([row, at]), np.concatenate([found, ids[lo + col]]), np.concatenate([d, exact])
        order = np.lexsort((found, d, row))
        row, found, d = row[order], found[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, found, d = row[place < k], found[place < k], d[place < k]
        full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
        worst[full] = d[np.searchsorted(row, full, side="right") - 1]
    return row, found, d


def _top(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """``files(path, mtime)`` whose modification second differs from the recorded one, or has none."""
    seen = state.select("path", F.col("mtime").alias("_was"))
    return files.join(seen, "path", "left").where(~F.col("mtime").eqNullSafe(F.col("_was"))).drop("_was")


def newest_chunks(chunks: DataFrame) -> DataFrame:
    """A row per chunk id: the last indexed. Re-indexing appends and never deletes."""
    row = F.struct(*chunks.columns)
    return chunks.groupBy(F.col("id").alias("_id")).agg(F.max_by(row, F.struct("indexed_at", "file_hash")).alias("r")).select("r.*")


def early_cutoff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of ``(key, value)`` whose value changed, came or went; equal values recompute nothing downstream."""
    o, n = old.select("key", F.col("value").alias("_o"), F.lit(1).alias("_in_o")), new.select("key", F.col("value").alias("_n"), F.lit(1).alias("_in_n"))
    both = o.join(n, "key", "full_outer")
    what = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select("key", what.alias("change")).where("change IS NOT NULL")
