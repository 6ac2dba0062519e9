"""Exact embedding near-duplicates by dual traversal of cover trees.

Equal vectors are collapsed first. Every distinct vector goes to the cell of its
nearest pivot and, in large cells, to one of several hash blocks, so a block is
bounded whatever the skew. One task a block builds its cover tree: nested levels of
centres with halving radii and, per node, the exact covering radius. Cell pairs and
then block pairs that the covering-radius bound allows are traversed level by level in
both trees at once; node pairs too far apart to hold a pair within the threshold are
pruned. Single precision only prunes (with a margin); links are decided in double.
A task emits link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.forest import Forest
from lodestrata.llm.scratch import sampled, table

BLOCK_ROWS = 4096
MAX_PIVOTS = 256
PIVOT_SAMPLE = 4096
LEVELS = 6
#: Slack of distance bounds, and of cosines in single precision.
MARGIN, SLACK = 1e-6, 1e-5
TREES = "block int, cell int, center binary, radius double, tree binary"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each usable vector (single precision where that is exact), else null."""
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = np.array(v, dtype=np.float64) + 0.0 if v and None not in v else None
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            with np.errstate(over="ignore"):
                y = x.astype(np.float32)
            exact = (y == x).all()
            out.append((b"f" + y.tobytes()) if exact else (b"d" + x.tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "key"])


def unit(keys: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision from keys of one dimension."""
    x = np.stack([np.frombuffer(k, dtype="<f4" if k[:1] == b"f" else "<f8", offset=1).astype(np.float64) for k in keys])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dim(key: bytes) -> int:
    return (len(key) - 1) // (4 if key[:1] == b"f" else 8)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors in single precision, to choose centres by."""
    dot = a.astype(np.float32) @ b.astype(np.float32).T
    return np.sqrt(np.maximum(2 - 2 * dot, 0))


class CoverTree:
    """Levels of centres: positions, each one's parent in the level above, and exact covering radii.

    Centres come in farthest-first order, so those of a level are a prefix of the next
    level's, lie farther apart than the level's radius, and cover every point within it.
    The last level is the points themselves.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        gaps = _gaps(x, x)
        near, owner, order = gaps[0].copy(), np.zeros(n, dtype=np.int64), [0]
        owners, sizes, radius = [], [], 2.0
        for _ in range(LEVELS):
            while len(order) < n and near.max() > radius:
                c = int(near.argmax())
                closer = gaps[c] < near
                near[closer], owner[closer] = gaps[c][closer], len(order)
                owner[c], near[c] = len(order), 0.0
                order.append(c)
            owners.append(owner.copy())
            sizes.append(len(order))
            radius /= 2
        rank = np.asarray(order, dtype=np.int64)
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        above = owners[-1]  # of each point, its ancestor's rank in the level above
        self.levels.append((np.arange(n), above, np.zeros(n)))
        for k in range(LEVELS - 1, -1, -1):
            cover = np.zeros(sizes[k])
            np.maximum.at(cover, above, np.linalg.norm(x - x[rank[above]], axis=1))
            parent = owners[k - 1][rank[: sizes[k]]] if k else np.zeros(sizes[k], dtype=np.int64)
            self.levels.append((rank[: sizes[k]], parent, cover))
            above = parent[above]
        self.levels.reverse()


def _open_dense(xa: np.ndarray, ra: np.ndarray, xb: np.ndarray, rb: np.ndarray, t: float) -> np.ndarray:
    """Node pairs that may hold points within ``t``, from one product of all centres.

    Nodes of one point, the many in high dimensions, need a comparison only.
    """
    dot = xa.astype(np.float32) @ xb.astype(np.float32).T
    reach = t + MARGIN
    out = dot >= np.float32(1 - reach * reach / 2 - SLACK)
    for side, r, other in ((0, ra, rb), (1, rb, ra)):
        wide = np.flatnonzero(r)
        if wide.size:
            sums = (r[wide, None] + other[None, :] + reach) if side == 0 else (other[:, None] + r[None, wide] + reach)
            part = (dot[wide] if side == 0 else dot[:, wide]) >= 1 - sums * sums / 2 - SLACK
            if side == 0:
                out[wide] = part
            else:
                out[:, wide] = part
    return out


def _expand(i: np.ndarray, j: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of node pairs (i, j), given each child's parent."""

    def kids(parent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.bincount(parent, minlength=n)
        return np.argsort(parent, kind="stable"), np.cumsum(count) - count, count

    oa, sa, ca = kids(pa_, int(i.max()) + 1)
    ob, sb, cb = kids(pb, int(j.max()) + 1)
    each = ca[i] * cb[j]
    at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    width = np.repeat(cb[j], each)
    return oa[np.repeat(sa[i], each) + at // width], ob[np.repeat(sb[j], each) + at % width]


PAIRS = 1 << 17


def _near(xa: np.ndarray, xb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs, some at a time."""
    out = np.empty(i.size, dtype=xa.dtype)
    for at in range(0, i.size, PAIRS):
        out[at : at + PAIRS] = np.einsum("ij,ij->i", xa[i[at : at + PAIRS]], xb[j[at : at + PAIRS]])
    return out


def candidates(a: CoverTree, b: CoverTree, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The point pairs that the dual traversal can't rule out.

    Both trees go down together. While most node pairs of a level are open their bounds
    come from one matrix product; once few are, pair by pair.
    """
    i = j = np.zeros(1, dtype=np.int64)
    for k in range(1, len(a.levels)):
        (ca, pa_, ra), (cb, pb, rb) = a.levels[k], b.levels[k]
        above = (len(a.levels[k - 1][0]), len(b.levels[k - 1][0]))
        kids = (np.bincount(pa_, minlength=above[0])[i] * np.bincount(pb, minlength=above[1])[j]).sum()
        if 8 * kids > ca.size * cb.size:
            open_ = _open_dense(a.x[ca], ra, b.x[cb], rb, t)
            if kids < ca.size * cb.size:
                parents = np.zeros(above, dtype=bool)
                parents[i, j] = True
                open_ &= parents[pa_][:, pb]
            i, j = np.nonzero(open_)
        else:
            i, j = _expand(i, j, pa_, pb)
            reach = ra[i] + rb[j] + (t + MARGIN)
            keep = _near(a.x, b.x, ca[i], cb[j]) >= 1 - reach * reach / 2 - 1e-9
            i, j = i[keep], j[keep]
        if not i.size:
            break
    return i, j


def links(a: CoverTree, b: CoverTree, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked point pairs (within one tree in both orders), decided in double precision."""
    i, j = candidates(a, b, math.sqrt(max(0.0, 2 - 2 * cosine)))
    keep = _near(a.x, b.x, i, j) >= cosine
    if same:
        keep &= i != j
    return i[keep], j[keep]


def _assign(pivots: dict[int, tuple[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index("key")).to_pylist()
            dims = np.array([_dim(k) for k in keys], dtype=np.int64)
            cell = np.zeros(len(keys), dtype=np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                first, centers = pivots[int(d)]
                for k in range(0, at.size, 4096):
                    part = at[k : k + 4096]
                    cell[part] = first + (unit([keys[i] for i in part]) @ centers.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    return run


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tree(block: int, cell: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        x = unit([r[2] for r in rows])
        t = CoverTree(x)
        body = pickle.dumps(([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], t.levels), protocol=5)
        center = x[t.levels[0][0][0]]
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([cell], pa.int32()), pa.array([center.tobytes()], pa.binary()), pa.array([float(t.levels[0][2][0]) + MARGIN]), pa.array([body], pa.binary())],
            names=["block", "cell", "center", "radius", "tree"],
        )

    now, held = None, []
    for b in batches:  # block, cell, node, n, key; sorted by block
        for block, cell, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if block != now:
                if held:
                    yield tree(*now_cell, held)
                now, now_cell, held = block, (block, cell), []
            held.append(tuple(row))
    if held:
        yield tree(*now_cell, held)


def _load(body: bytes) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    nodes, weights, keys, levels = pickle.loads(body)
    t = CoverTree.__new__(CoverTree)
    t.x, t.levels = unit(keys), levels
    return np.asarray(nodes, dtype=np.int64), np.asarray(weights, dtype=np.int64), t


def _traverse(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        bodies = dict(zip(rows.column("side").to_pylist(), rows.column("tree").to_pylist(), strict=True))
        nodes, weights, a = _load(bodies[0])
        same = 1 not in bodies
        other, others, b = (nodes, weights, a) if same else _load(bodies[1])
        shift = 0 if same else len(nodes)
        every = nodes if same else np.concatenate([nodes, other])
        count = np.zeros(len(every), dtype=np.int64)
        forest = Forest(len(every))
        i, j = links(a, b, same, cosine)
        count += np.bincount(i, weights=others[j], minlength=len(every)).astype(np.int64)
        if not same:
            count += np.bincount(j + shift, weights=weights[i], minlength=len(every)).astype(np.int64)
        forest.union(i, j + shift)
        at = np.flatnonzero(count)
        return pa.table({"node": every[at], "links": count[at], "root": every[forest.find(at)]}, schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    return run


def _pivots(distinct: DataFrame, block_rows: int) -> dict[int, tuple[int, np.ndarray]]:
    """Farthest-first centres by dimension, from at most PIVOT_SAMPLE vectors; they only place cells."""
    n = distinct.count()
    few = sampled(distinct, F.xxhash64("key"), n, PIVOT_SAMPLE)
    picked = sorted(r["key"] for r in few.select("key").limit(2 * PIVOT_SAMPLE).collect())
    dims = {r["d"]: r["n"] for r in distinct.groupBy(_dim_column().alias("d")).agg(F.count("*").alias("n")).collect()}
    out, first = {}, 0
    for d in sorted(dims):
        own = [k for k in picked if _dim(bytes(k)) == d]
        wanted = min(MAX_PIVOTS, max(1, -(-dims[d] // block_rows)))
        centers = np.eye(1, d) if not own else unit([bytes(k) for k in own])
        if own:
            near, chosen = np.full(len(centers), np.inf), [0]
            while len(chosen) < min(wanted, len(centers)):
                near = np.minimum(near, 2 - 2 * centers @ centers[chosen[-1]])
                chosen.append(int(near.argmax()))
            centers = centers[chosen]
        out[d] = (first, centers)
        first += len(centers)
    return out


def _dim_column():
    return F.expr("CAST((length(key) - 1) / IF(substring(key, 1, 1) = X'66', 4, 8) AS INT)")


def near_links(distinct: DataFrame, cosine: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(node, links, root)`` partial counts and spanning links over ``distinct(node, n, key)``."""
    spark = distinct.sparkSession
    pivots = _pivots(distinct, block_rows)
    schema = distinct.withColumn("cell", F.lit(0)).schema
    placed = table(distinct.mapInArrow(_assign(pivots), schema), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows")).collect()  # at most MAX_PIVOTS a dimension
    first, starts = 0, []
    for r in sorted(sizes):
        blocks = -(-r["rows"] // block_rows)
        starts.append((r["cell"], first, blocks))
        first += blocks
    if not starts:
        return spark.createDataFrame([], "node bigint, links bigint, root bigint")
    small = F.broadcast(spark.createDataFrame(starts, "cell int, first int, blocks int"))
    rows = placed.join(small, "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    rows = rows.select("block", "cell", "node", "n", "key")
    trees = table(rows.repartition(first, "block").sortWithinPartitions("block").mapInArrow(_grow, TREES), "trees")
    reach = trees.groupBy("cell").agg(F.max("radius").alias("r")).collect()
    cells = _cell_pairs(pivots, [r["cell"] for r in reach])
    pairs = spark.createDataFrame(cells, "cell int, cell_b int")
    meta = trees.select("block", "cell", "center", "radius")
    other = meta.toDF("block_b", "cell_b", "center_b", "radius_b")
    pairs = F.broadcast(pairs).join(meta, "cell").join(other, "cell_b").where("block <= block_b")
    pairs = pairs.where(_in_reach(math.sqrt(max(0.0, 2 - 2 * cosine)))(F.col("center"), F.col("radius"), F.col("center_b"), F.col("radius_b")))
    pairs = pairs.select((F.col("block").cast("bigint") * (1 << 31) + F.col("block_b")).alias("pair"), "block", "block_b")
    sides = pairs.select("pair", F.lit(0).alias("side"), "block").unionByName(pairs.where("block <> block_b").select("pair", F.lit(1).alias("side"), F.col("block_b").alias("block")))
    loaded = table(sides, "pairs").join(trees.select("block", "tree"), "block")
    return loaded.groupBy("pair").applyInArrow(_traverse(cosine), "node bigint, links bigint, root bigint")


def _cell_pairs(pivots: dict[int, tuple[int, np.ndarray]], used: list[int]) -> list[tuple[int, int]]:
    """Cells of one dimension, paired both ways; block centres prune further."""
    dim = {first + k: d for d, (first, centers) in pivots.items() for k in range(len(centers))}
    return [(a, b) for a in used for b in used if dim[a] == dim[b]]


def _in_reach(t: float):
    @F.pandas_udf("boolean")
    def reach(a, ra, b, rb):
        import pandas as pd

        return pd.Series([float(np.linalg.norm(np.frombuffer(x) - np.frombuffer(y))) <= p + q + t + MARGIN for x, p, y, q in zip(a, ra, b, rb, strict=True)], dtype=bool)

    return reach


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per input row.

    Two vectors link when their cosine in double precision reaches ``cosine``. Null,
    empty and zero vectors, and those with null or non-finite components, link with
    nothing, nor do vectors of different lengths; such a row is its own component.
    Equal vectors in several rows link with each other. Repeated ids are separate rows;
    a null id counts as a link but never names a component unless all ids of its
    component are null. An empty table gives an empty table.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    keyed = table(rows.mapInArrow(_keys, "vec_id bigint, key binary"), "vectors")
    distinct = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = table(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = table(near_links(distinct.select("node", "n", "key"), cosine, block_rows), "near")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.join(counts, "node", "left").join(labels, "node", "left")
    named = table(named.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "node").alias("label")), "named")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key = named.join(names, "label").select("key", "n_links", "component_id")
    out = keyed.join(by_key, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
