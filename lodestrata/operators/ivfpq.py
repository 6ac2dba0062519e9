"""An inverted-file index with product-quantised codes, for nearest neighbours that needn't read every vector.

Centres of cells and codebooks are fitted on a bounded sample; then every vector gets its
cell and the code of what its centre leaves. A query reads the codes of its nearest cells,
adds up table entries instead of multiplying vectors, and the best of them are ranked anew
by their exact distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.vector import VectorError, squared_distance
from lodestrata.session import stored

#: Vectors that centres and codebooks are fitted on; centres at most; values of a code byte; rows of a cell's slice.
SAMPLE, MAX_CELLS, BOOK, SLICE = 32_768, 4_096, 256, 65_536
ROUNDS = 8


@dataclass
class IvfPq:
    """``codes(cell, slice, id, code)`` of every vector, ``vectors(id, v)``, centres (cells x dim) and books (parts x BOOK x width)."""

    codes: DataFrame
    vectors: DataFrame
    centres: object
    books: object
    rows: int

    def write(self, folder: str) -> None:
        """Keeps the index; the codes by cell, so that a scan of few cells reads few files."""
        self.codes.repartition("cell").write.partitionBy("cell").mode("overwrite").parquet(f"{folder}/codes")
        self.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
        spark = self.codes.sparkSession
        spark.createDataFrame([(self.centres.tolist(), self.books.tolist(), self.rows)], "centres array<array<float>>, books array<array<array<float>>>, rows bigint").write.mode("overwrite").parquet(f"{folder}/model")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> IvfPq:
        import numpy as np

        model = spark.read.parquet(f"{folder}/model").first()
        codes = spark.read.schema("slice int, id bigint, code binary, cell int").parquet(f"{folder}/codes").select("cell", "slice", "id", "code")
        return IvfPq(codes, spark.read.parquet(f"{folder}/vectors"), np.array(model["centres"], np.float32), np.array(model["books"], np.float32), model["rows"])


def build(chunks: DataFrame, vector: str = "embedding", key: str = "id", cells: int | None = None, parts: int | None = None) -> IvfPq:
    """The index of all chunks; null vectors and those with null or non-finite components are left out.

    ``cells`` is the root of the number of vectors by default, ``parts`` (code bytes) a
    quarter of the dimension. Vectors of several lengths are a ``dim_mismatch``.
    """
    import numpy as np

    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = chunks.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v IS NOT NULL AND id IS NOT NULL").where(~bad)
    own = stored(own, "vectors")
    head = own.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dim")).first()
    if head["low"] != head["dim"]:
        raise VectorError("dim_mismatch", f"vectors have {head['low']} to {head['dim']} components")
    n, dim = head["n"], head["dim"] or 1
    cells = max(1, min(MAX_CELLS, n, cells or math.ceil(math.sqrt(n))))
    parts = parts or max(1, dim // 4)
    while dim % parts:
        parts -= 1
    drawn = own.orderBy(F.xxhash64("v"), "id").limit(SAMPLE)
    sample = np.array([r["v"] for r in drawn.select("v").collect()], np.float32).reshape(-1, dim)
    centres = _centres(own, sample, cells, dim)
    books = _books(own.sparkSession, sample, centres, parts)
    sizes = own.mapInArrow(lambda b: _coded(b, centres, books), "cell int, id bigint, code binary")
    sizes = stored(sizes, "codes")
    slices = sizes.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # a row a cell
    codes = sizes.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    return IvfPq(stored(codes.select("cell", "slice", "id", "code"), "codes"), own, centres, books, n)


def _nearest_of(x, centres):
    """Each row's nearest centre."""
    return (-2 * (x @ centres.T) + (centres * centres).sum(axis=1)).argmin(axis=1)


def _centres(own: DataFrame, sample, cells: int, dim: int):
    """k-means by rounds of one aggregation: a task adds up its own vectors per cell, a row a cell reaches the driver."""
    import numpy as np
    import pyarrow as pa

    if not len(sample):
        return np.zeros((1, dim), np.float32)
    centres = sample[np.random.default_rng(0).choice(len(sample), min(cells, len(sample)), replace=False)]
    spread = own.sparkSession.createDataFrame([(x.tolist(),) for x in sample], "v array<float>").repartition(own.sparkSession.sparkContext.defaultParallelism)
    spread = stored(spread, "sample")
    for _ in range(ROUNDS):
        now = centres

        def add(batches: Iterator, now=now) -> Iterator:
            total, count = np.zeros(now.shape), np.zeros(len(now), np.int64)
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                at = _nearest_of(x, now)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(now))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.float64())), pa.array(count[used])], names=["cell", "total", "n"])

        sums = spread.mapInArrow(add, "cell int, total array<double>, n bigint").select("cell", F.posexplode("total").alias("k", "x"), "n")
        sums = sums.groupBy("cell", "k").agg((F.sum("x") / F.sum("n")).alias("x")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("x"))
        centres = now.copy()
        for r in sums.collect():  # a row a cell
            centres[r["cell"]] = [e["x"] for e in r["x"]]
    return centres.astype(np.float32)


def _books(spark: SparkSession, sample, centres, parts: int):
    """A codebook per part of the vector, each fitted in a task of its own on the sample."""
    import numpy as np
    import pyarrow as pa

    width = centres.shape[1] // parts
    left = (sample - centres[_nearest_of(sample, centres)]).reshape(len(sample), parts, width) if len(sample) else np.zeros((1, parts, width), np.float32)

    def fit(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            for part in b.column("id").to_pylist():
                x, r = left[:, part], np.random.default_rng(part)
                book = x[r.choice(len(x), BOOK, replace=len(x) < BOOK)]
                for _ in range(ROUNDS):
                    at = _nearest_of(x, book)
                    total, count = np.zeros(book.shape), np.bincount(at, minlength=BOOK)
                    np.add.at(total, at, x)
                    book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book).astype(np.float32)
                out.append(book.ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float32()))], names=["part", "book"])

    got = spark.range(0, parts, 1, parts).mapInArrow(fit, "part bigint, book array<float>").collect()  # BOOK x dim numbers in all
    books = np.zeros((parts, BOOK, width), np.float32)
    for r in got:
        books[r["part"]] = np.array(r["book"], np.float32).reshape(BOOK, width)
    return books


def _coded(batches: Iterator, centres, books) -> Iterator:
    import numpy as np
    import pyarrow as pa

    parts, _, width = books.shape
    for b in batches:
        x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
        cell = _nearest_of(x, centres)
        left = (x - centres[cell]).reshape(len(x), parts, width)
        code = np.column_stack([_nearest_of(left[:, p], books[p]) for p in range(parts)]).astype(np.uint8) if len(x) else np.zeros((0, parts), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id"), pa.array([c.tobytes() for c in code], pa.binary())], names=["cell", "id", "code"])


def search(index: IvfPq, queries: DataFrame, k: int = 10, probe: float = 0.55, again: int = 10) -> DataFrame:
    """For each ``queries(query_id, v)`` the ``k`` nearest vectors found: query_id, id, distance, rank.

    The nearest cells that hold a share ``probe`` of all vectors are read; ``again`` times
    ``k`` of their codes are ranked by exact squared distance, ties to the smaller id.
    """
    asked = stored(queries.where("v IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("v").cast("array<float>").alias("v")), "queries")
    sent = stored(routed(index, asked, probe), "routed")
    parts = index.codes.select("cell", "slice").distinct()  # a row a slice
    sent = sent.join(F.broadcast(parts), "cell").select("cell", "slice", F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.lit(None).cast("binary").alias("code"), "v")
    rows = index.codes.select("cell", "slice", F.lit(0).alias("kind"), "id", "code", F.lit(None).cast("array<float>").alias("v")).unionByName(sent)
    dealt = rows.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "kind", "id")
    centres, books, top = index.centres, index.books, k * again
    about = dealt.mapInArrow(lambda b: _looked_up(b, centres, books, top), "query_id bigint, id bigint, about float")
    best = Window.partitionBy("query_id").orderBy("about", "id")
    about = about.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top).select("query_id", "id")
    near = about.join(index.vectors.withColumnRenamed("v", "x"), "id").join(asked, "query_id")
    near = near.select("query_id", "id", squared_distance(F.col("v"), F.col("x")).alias("distance"))
    exact = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= k)


def routed(index: IvfPq, queries: DataFrame, probe: float) -> DataFrame:
    """``(query_id, v, cell)``: for each query its nearest cells until they hold a share ``probe`` of all vectors."""
    import numpy as np
    import pyarrow as pa

    sizes = np.zeros(len(index.centres), np.int64)
    for r in index.codes.groupBy("cell").count().collect():  # a row a cell
        sizes[r["cell"]] = r["count"]
    centres, wanted = index.centres, probe * sizes.sum()

    def route(batches: Iterator) -> Iterator:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
            order = np.argsort(-2 * (x @ centres.T) + (centres * centres).sum(axis=1), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, at = np.nonzero(before < wanted)
            cell = order[row, at]
            full = sizes[cell] > 0
            row, cell = row[full], cell[full]
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["query_id", "v", "cell"])

    return queries.mapInArrow(route, "query_id bigint, v array<float>, cell int")


def _looked_up(batches: Iterator, centres, books, top: int) -> Iterator:
    """In each slice of a cell the codes, then the queries: per query the ``top`` smallest sums of table entries."""
    import numpy as np
    import pyarrow as pa

    parts, size, width = books.shape
    now, ids, codes, held = None, [], [], None
    for b in batches:
        out = []
        for cell, piece, kind, i, code, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (cell, piece) != now:
                now, ids, codes, held = (cell, piece), [], [], None
            if kind == 0:
                ids.append(i)
                codes.append(code)
                continue
            if held is None:
                flat = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, parts).astype(np.int64) + np.arange(parts) * size
                held = np.array(ids, np.int64), flat
            left = (np.array(v, np.float32) - centres[cell]).reshape(parts, 1, width)
            table = ((left - books) ** 2).sum(axis=2).ravel()
            about = table[held[1]].sum(axis=1)
            few = np.argpartition(about, top - 1)[:top] if len(about) > top else np.arange(len(about))
            out.append((np.full(len(few), i), held[0][few], about[few]))
        if out:
            q, n, d = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(d.astype(np.float32))], names=["query_id", "id", "about"])
