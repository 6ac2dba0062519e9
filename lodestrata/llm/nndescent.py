"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, searched greedily.

Equal vectors are one node. Nodes are numbered in the order of a projection tree that is
fitted on a bounded sample, and cut into blocks of equal size, each a task; first lists are
the best of the node's own blocks in several such trees. NN-descent joins each node's
neighbours with each other, round by round: a block asks the others for the vectors that
its lists name, once each, and what improves a node's list is merged in the node's block.
A query is a node too. It starts with the best of its blocks and of some entry points and
expands the unexpanded nodes of its beam, a round at a time, until none is left: it asks
for their lists, then sends itself to the blocks of the nodes that these name.

Between tasks go rows of arrays, one for many nodes (``_SENT``), shuffled by block; what
goes in a round is bounded by lists and beams, and by a block's own vectors once.

Inner products are made comparable by one more component (all nodes get equal length), so
the graph is one of plain distances. Single precision finds, double precision ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import place, shielded, table
from lodestrata.operators.graph import numbered

#: Neighbours of a node, as many of those that name it, and nodes of a block at most and at least.
NEIGHBOURS, BLOCK_ROWS, LEAST_ROWS = 32, 8_192, 512
#: Projection trees, vectors on which they are fitted, their leaves' share of them, and entry points.
TREES, SAMPLE, LEAF, ENTRIES = 8, 16_384, 16, 256
#: Descent ends when a round renews less than this share of all list entries, or after so many rounds.
RENEWED, ROUNDS = 0.01, 8
#: Entries that a task gathers before it keeps the best.
HELD = 1 << 18
#: A query's beam; all of it that is unexpanded is expanded in a round.
BEAM = 160
#: Bytes of the rows that a task hands on at once.
PACKED = 1 << 20

#: A row for a block: what it is, the block it comes from, a count, and arrays of numbers.
_SENT = "block int, kind int, origin int, n bigint, a binary, b binary, c binary, d binary, e binary"
VECTORS, QUERIES, LISTS, BEAMS, NAMERS, AROUND, WANTED, GIVEN, FOUND, WENT, ASKED, SEEN = range(12)


@dataclass
class Index:
    """Valid ``rows``, ``nodes`` (pos, v, ids), ``base`` vectors and queries a block, ``around`` lists both ways, first ``beams``, and sizes."""

    rows: DataFrame
    nodes: DataFrame
    base: DataFrame
    around: DataFrame
    beams: DataFrame
    dim: int
    blocks: int
    size: int


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """For each row whose vec_id is divisible by ``every`` its ``k`` nearest other rows found: query_id, rank, vec_id, score.

    Largest inner product first, ties to the smaller id; all candidates where they are
    fewer than ``k``. Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows without an id take no part. Rows that repeat an id and its vector
    count once; a row's own are all rows of its id. Vectors of several lengths are a
    ValueError. Copies are one node with its k + 1 smallest ids, so they cost nothing and
    crowd nobody out; those that ask are one search. Other columns are ignored, whatever
    their names; an empty table gives an empty one.
    """
    index = build(vectors, keep=k + 1, every=every)
    own = index.rows.where(F.col("id") % every == 0).select("id", "h1", "h2").distinct()
    asked = own.join(index.nodes.select("h1", "h2", "pos"), ["h1", "h2"]).select(F.col("id").alias("query_id"), F.col("pos").alias("key"))
    return _ranked(index, asked, search(index), k)


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part: ``id``, two hashes of the vector, the vector and its length."""
    rows = shielded(vectors).select(F.col(place(vectors, "vec_id")).cast("bigint").alias("id"), F.col(place(vectors, "embedding")).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), F.col("v").cast("array<double>").alias("v"))
    return rows.mapInArrow(_fine, "id bigint, h1 bigint, h2 bigint, v array<double>, norm double")


def _fine(batches: Iterator) -> Iterator:
    """Drops vectors that are zero or hold null or non-finite components, and adds the length, without overflow in its squares."""
    import numpy as np
    import pyarrow as pa

    def flat(b):
        lengths = _rows_of(b.column("v").value_lengths().to_numpy(zero_copy_only=False))
        return b.column("v").flatten().to_numpy(zero_copy_only=False), lengths[:-1], np.diff(lengths)

    for b in batches:
        v, _, lengths = flat(b)
        of = np.repeat(np.arange(len(lengths)), lengths)
        b = b.filter(pa.array((np.bincount(of, ~np.isfinite(v), len(lengths)) == 0) & (np.bincount(of, v != 0, len(lengths)) > 0)))
        v, starts, lengths = flat(b)
        top = np.maximum.reduceat(np.abs(v), starts) if len(starts) else v
        norm = top * np.sqrt(np.add.reduceat((v / np.repeat(top, lengths)) ** 2, starts)) if len(starts) else v
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm, pa.float64())], names=["id", "h1", "h2", "v", "norm"])


def build(vectors: DataFrame, keep: int, every: int) -> Index:
    """The graph over all distinct valid vectors, each with its ``keep`` smallest ids."""
    rows = table(_valid(vectors), "rows")
    ids = rows.groupBy("h1", "h2", "id").agg(F.lit(1)).select("h1", "h2", "id")
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= keep)
    ids = ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    first = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.first("norm").alias("norm"), F.max(F.col("id") % every == 0).alias("asks"))
    distinct = table(first.join(ids, ["h1", "h2"]), "distinct")
    head = distinct.agg(F.count("*").alias("n"), F.max("norm").alias("scale"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dim")).first()
    if head["low"] != head["dim"]:
        raise ValueError(f"vectors have {head['low']} to {head['dim']} components")
    count, dim, scale = head["n"], head["dim"] or 1, head["scale"] or 1.0
    if count >= 1 << 31:
        raise ValueError(f"{count} distinct vectors are more than numbers of 32 bits")
    # no more than BLOCK_ROWS a block, and work for all cores where that leaves a block LEAST_ROWS
    busy = min(vectors.sparkSession.sparkContext.defaultParallelism, count // LEAST_ROWS)
    blocks = max(1, busy, math.ceil(count / BLOCK_ROWS))
    size = max(1, math.ceil(count / blocks))
    trees, entry = _fit(distinct, dim, scale, min(TREES, blocks))
    schema = "h1 bigint, h2 bigint, v array<double>, ids array<bigint>, vec binary, q binary, leaf0 int, leaves binary"
    placed = distinct.select("h1", "h2", "v", "ids", "asks").mapInArrow(lambda b: _placed(b, dim, scale, trees), schema)
    nodes = table(numbered(placed, ["leaf0", "h1", "h2"], "pos").withColumn("pos", F.col("pos") - 1), "nodes")
    # entry points are known by what they are until they have a number
    seeds = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(entry, "h1 bigint, h2 bigint")), ["h1", "h2"], "left_semi").select("pos", "vec")
    seeds = tuple((r["pos"], bytes(r["vec"])) for r in seeds.collect())  # at most 2 ENTRIES

    leaves = 1 << trees[0][2]
    counts = [[0] * leaves for _ in trees]  # a number a leaf
    for r in nodes.select("leaves").mapInArrow(lambda b: _leaves(b, len(trees), leaves), "tree int, leaf int, n bigint").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["tree"]][r["leaf"]] = r["n"]
    dealt = nodes.select("pos", "vec", "q", "leaves")
    base = dealt.mapInArrow(lambda b: _dealt(b, dim, counts[:1], len(counts), blocks, size), _SENT)
    base = table(_step(base, blocks, lambda block, got: _based(block, got, dim)), "base")
    near = dealt.mapInArrow(lambda b: _dealt(b, dim, counts, len(counts), blocks, size), _SENT)
    near = _step(near, len(counts) * blocks, lambda block, got: _within(block, got, dim, blocks, size, seeds))
    first = table(_step(near, blocks, _gathered), "first")
    lists = first.where(F.col("kind") == LISTS)
    for number in range(ROUNDS):
        lists = table(_descend(base, lists, number, dim, blocks, size), "lists")
        if (lists.agg(F.sum("n")).first()[0] or 0) <= RENEWED * NEIGHBOURS * count:
            break
    around = _step(lists.mapInArrow(lambda b: _received(b, lambda block, got: _scattered(block, got, size)), _SENT), blocks, lambda block, got: _both(block, got, size))
    return Index(rows, nodes, base, table(around, "around"), first.where(F.col("kind") == BEAMS), dim, blocks, size)


def _fit(distinct: DataFrame, dim: int, scale: float, trees: int) -> tuple[list, list]:
    """Projection trees, each as (normals, offsets) of a full binary tree, and the keys of entry points: a sample and the longest vectors."""
    import numpy as np

    drawn = distinct.orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(SAMPLE).select("h1", "h2", "v").collect()
    longest = distinct.orderBy(F.desc("norm"), "h1", "h2").limit(ENTRIES).select("h1", "h2").collect()
    entry = [(r["h1"], r["h2"]) for r in [*drawn[:ENTRIES], *longest]]
    x = np.array([r["v"] for r in drawn], np.float64).reshape(-1, dim) / scale
    depth = max(0, math.ceil(math.log2(max(1, len(x)) / LEAF)))
    return [_tree(x, depth, 1 + seed) for seed in range(trees)], entry


def _tree(x, depth: int, seed: int) -> tuple:
    import numpy as np

    normals, offsets = np.zeros((2**depth - 1, x.shape[1]), np.float32), np.zeros(2**depth - 1, np.float32)
    r, parts = np.random.default_rng(seed), {0: np.arange(len(x))}
    for node in range(len(normals)):
        own = parts.pop(node)
        if len(own) < 2:
            parts[2 * node + 1], parts[2 * node + 2] = own, own[:0]
            continue
        # between the means of two halves that two random members draw
        a, b = x[r.choice(own, 2, replace=False)]
        side = ((x[own] - a) ** 2).sum(axis=1) < ((x[own] - b) ** 2).sum(axis=1)
        normals[node] = (x[own[side]].mean(axis=0) if side.any() else a) - (x[own[~side]].mean(axis=0) if (~side).any() else b)
        at = x[own] @ normals[node]
        offsets[node] = np.median(at)
        parts[2 * node + 1], parts[2 * node + 2] = own[at < offsets[node]], own[at >= offsets[node]]
    return normals, offsets, depth


def _placed(batches: Iterator, dim: int, scale: float, trees: list) -> Iterator:
    """Adds the single-precision vector of equal length, a query's direction, and the trees' leaves."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = v / scale
        more = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        full = np.column_stack([x, more]).astype(np.float32)
        q = v / np.abs(v).max(axis=1, keepdims=True)
        q = np.column_stack([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros(len(v))]).astype(np.float32)
        leaves = np.zeros((len(x), len(trees)), np.int32)
        for t, (normals, offsets, depth) in enumerate(trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + ((x * normals[at]).sum(axis=1) >= offsets[at])
            leaves[:, t] = at - (2**depth - 1)
        asks = b.column("asks").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("h1", "h2", "v", "ids")), pa.array([f.tobytes() for f in full], pa.binary()),
             pa.array([f.tobytes() if a else None for f, a in zip(q, asks, strict=True)], pa.binary()), pa.array(leaves[:, 0]), pa.array([f.tobytes() for f in leaves], pa.binary())],
            names=["h1", "h2", "v", "ids", "vec", "q", "leaf0", "leaves"],
        )


def _leaves(batches: Iterator, trees: int, leaves: int) -> Iterator:
    """Nodes a leaf, added up over a task."""
    import numpy as np
    import pyarrow as pa

    n = np.zeros((trees, leaves), np.int64)
    for b in batches:
        for t, at in enumerate(_matrix(b.column("leaves").to_pylist(), trees, np.int32).T):
            n[t] += np.bincount(at, minlength=leaves)
    tree, leaf = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(n[tree, leaf])], names=["tree", "leaf", "n"])


def _matrix(rows: list, width: int, kind):
    import numpy as np

    return np.frombuffer(b"".join(rows), kind).reshape(-1, width)


def _packed(messages: Iterator) -> Iterator:
    """``(block, kind, origin, n, arrays...)`` as rows of ``_SENT``."""
    import pyarrow as pa

    def batch():
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[4:])],
            names=["block", "kind", "origin", "n", "a", "b", "c", "d", "e"],
        )

    held, size = [], 0
    for block, kind, origin, n, *arrays in messages:
        arrays = [x.tobytes() for x in arrays]
        held.append((int(block), kind, int(origin), int(n), *arrays, *[None] * (5 - len(arrays))))
        size += sum(map(len, arrays))
        if size > PACKED:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _received(batches: Iterator, work: Callable) -> Iterator:
    """What ``work(block, rows by kind)`` sends, for each block of the task."""
    blocks = {}
    for b in batches:
        arrays = [b.column(c) for c in "abcde"]
        for i, (block, kind, origin) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "kind", "origin")), strict=True)):
            blocks.setdefault(block, {}).setdefault(kind, []).append((origin, *(x[i].as_buffer() for x in arrays if x[i].is_valid)))
    while blocks:
        block, got = blocks.popitem()
        for rows in got.values():
            rows.sort(key=lambda r: r[0])
        yield from _packed(work(block, got))


def _step(rows: DataFrame, blocks: int, work: Callable) -> DataFrame:
    """Rows go to their block, a task each, and what ``work`` makes of them goes on."""
    return rows.repartitionById(blocks, F.col("block")).mapInArrow(lambda b: _received(b, work), _SENT)


def _arrays(rows: list, *kinds) -> list:
    """The arrays of several rows, joined."""
    import numpy as np

    return [np.concatenate([np.frombuffer(r[1 + i], kind) for r in rows] or [np.zeros(0, kind)]) for i, kind in enumerate(kinds)]


def _again(block: int, got: dict, *kinds: int) -> Iterator:
    """Rows that the block keeps for the next step."""
    import numpy as np

    for kind in kinds:
        for origin, *arrays in got.get(kind, ()):
            yield block, kind, origin, 0, *(np.frombuffer(x, np.uint8) for x in arrays)


def _split(by, size: int, *arrays) -> Iterator:
    """``(block, arrays)``, dealt by the block of each number in ``by``."""
    import numpy as np

    to = by // size
    order = np.argsort(to, kind="stable")
    names, starts = np.unique(to[order], return_index=True)
    for name, lo, hi in zip(names, starts, np.append(starts[1:], len(to)), strict=False):  # none, where nothing is dealt
        yield name, [x[order[lo:hi]] for x in arrays]


def _rows_of(lengths):
    """Where each of some lists that follow each other begins, and the end."""
    import numpy as np

    return np.concatenate([[0], np.cumsum(lengths)])


def _dealt(batches: Iterator, dim: int, counts: list, trees: int, blocks: int, size: int) -> Iterator:
    """Nodes to their block in each tree: by number in the first, by leaf, and by chance within a leaf, in the others."""
    import numpy as np

    def sent() -> Iterator:
        for b in batches:
            pos = b.column("pos").to_numpy().astype(np.int32)
            vec, asks = _matrix(b.column("vec").to_pylist(), dim + 1, np.float32), b.column("q").is_valid().to_numpy(zero_copy_only=False)
            q = np.zeros((len(pos), dim + 1), np.float32)
            q[asks] = _matrix(b.column("q").drop_null().to_pylist(), dim + 1, np.float32)
            leaves = _matrix(b.column("leaves").to_pylist(), trees, np.int32)
            for t, n in enumerate(np.array(counts)):
                at = pos.astype(np.int64)
                if t:
                    h = (at.astype(np.uint64) + np.uint64(t << 40)) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    leaf = leaves[:, t]
                    at = (np.cumsum(n) - n)[leaf] + (n[leaf] * ((h >> np.uint64(11)) / 2.0**53)).astype(np.int64)
                for to, (p, v, a, d) in _split(at, size, pos, vec, asks, q):
                    yield t * blocks + to, VECTORS, t, 0, p, v, a, d[a]

    yield from _packed(sent())


def _block_rows(got: dict, dim: int):
    """A block's numbers, in order, their vectors, which of them ask, and the queries' directions."""
    import numpy as np

    pos, vec, asks, q = _arrays(got[VECTORS], np.int32, np.float32, bool, np.float32)
    order = np.argsort(pos)
    at = np.cumsum(asks) - 1
    return pos[order], vec.reshape(-1, dim + 1)[order], asks[order], q.reshape(-1, dim + 1)[at[order][asks[order]]]


def _based(block: int, got: dict, dim: int) -> Iterator:
    pos, x, asks, q = _block_rows(got, dim)
    yield block, VECTORS, 0, 0, pos, x
    yield block, QUERIES, 0, 0, pos[asks], q


def _top(s, width: int):
    """Places of at least the ``width`` largest of each row (all, where they are fewer), in order, and few more."""
    import numpy as np

    n = s.shape[1]
    if n <= width or not width:
        return np.nonzero(np.full(s.shape, width > 0))
    if (c := n // (4 * width)) > 1:
        # as many parts of a row as have a largest value of the bound or more have at least so many values
        most = s[:, : n // c * c].reshape(len(s), c, -1).max(axis=1)
        high = (s >= np.partition(most, -width, axis=1)[:, -width][:, None]).ravel()
        if np.count_nonzero(high) <= 3 * width * len(s):  # else there are many ties
            high = np.concatenate([high, np.zeros(-len(high) % 8, bool)])
            words = np.flatnonzero(high.view(np.uint64))  # eight at a time; most are empty
            word, at = np.nonzero(high.reshape(-1, 8)[words])
            return np.divmod(words[word] * 8 + at, n)
    near = np.sort(np.argpartition(-s, width - 1, axis=1)[:, :width], axis=1)
    return np.repeat(np.arange(len(s)), width), near.ravel()


def _within(block: int, got: dict, dim: int, blocks: int, size: int, entry: tuple) -> Iterator:
    """The first lists: each node's best of its own block of a tree, and each query's."""
    import numpy as np

    def found(kind: int, key, q, pos, x, width: int, own: bool) -> Iterator:
        for lo in range(0, len(key), 512):
            s = q[lo : lo + 512] @ x.T
            if own:
                s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            i, j = _top(s, min(width, len(pos) - own))
            if len(i):
                k, p, v, _ = _best(key[lo + i], pos[j], s[i, j], np.zeros(len(i), bool), width)
                yield from ((to, kind, block, 0, *arrays) for to, arrays in _split(k, size, k, p, v))

    pos, x, asks, q = _block_rows(got, dim)
    yield from found(FOUND, pos, x, pos, x, NEIGHBOURS, True)
    yield from found(SEEN, pos[asks], q, pos, x, BEAM, False)
    if block < blocks and entry:
        yield from found(SEEN, pos[asks], q, np.array([p for p, _ in entry], np.int32), _matrix([v for _, v in entry], dim + 1, np.float32), 8, False)


def _gathered(block: int, got: dict) -> Iterator:
    """Lists and beams from what the trees' blocks found."""
    import numpy as np

    for kind, found, width in ((LISTS, FOUND, NEIGHBOURS), (BEAMS, SEEN, BEAM)):
        if found in got:
            key, pos, score = _arrays(got[found], np.int32, np.int32, np.float32)
            key, pos, score, flag = _best(key, pos, score, np.zeros(len(key), bool), width)
            yield block, kind, 0, len(key), key, pos, score, flag


def _best(key, pos, score, flag, width: int):
    """Per key the ``width`` largest scores (ties to the smaller number), a position once; a set flag wins."""
    import numpy as np

    if not len(key):
        return key, pos, score, flag
    both = key.astype(np.uint64) << np.uint64(32) | pos.astype(np.uint64)
    if (both[1:] <= both[:-1]).any():
        order = np.argsort(both)
        key, pos, score, flag, both = key[order], pos[order], score[order], flag[order], both[order]
        starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        key, pos, score, flag = key[starts], pos[starts], np.maximum.reduceat(score, starts), np.logical_or.reduceat(flag, starts)
    bits = score.astype(np.float32).view(np.uint32)  # as numbers in the order of falling scores
    bits = np.where(bits >> np.uint32(31), bits, ~bits & np.uint32(0x7FFFFFFF))
    order = np.argsort(key.astype(np.uint64) << np.uint64(32) | bits, kind="stable")
    key, pos, score, flag = key[order], pos[order], score[order], flag[order]
    top = np.arange(len(key)) - np.searchsorted(key, key) < width
    return key[top], pos[top], score[top], flag[top]


def _merged(block: int, got: dict, kind: int, width: int) -> Iterator:
    """Lists with what was found for them, which is not known yet."""
    import numpy as np

    key, pos, score, flag = _arrays(got.get(kind, []), np.int32, np.int32, np.float32, bool)
    more = _arrays(got.get(FOUND, []), np.int32, np.int32, np.float32)
    flags = np.concatenate([np.ones(len(key), bool) if kind == LISTS else flag, np.zeros(len(more[0]), bool)])
    key, pos, score, flag = _best(*(np.concatenate(x) for x in zip((key, pos, score), more, strict=True)), flags, width)
    if len(key):
        yield block, kind, 0, (~flag).sum(), key, pos, score, flag


def _scattered(block: int, got: dict, size: int) -> Iterator:
    """A block's lists to itself, and each entry to the block of the node that it names."""
    import numpy as np

    yield from _again(block, got, LISTS)
    key, pos, _, flag = _arrays(got[LISTS], np.int32, np.int32, np.float32, bool)
    for to, arrays in _split(pos, size, pos, key, flag):
        yield to, NAMERS, block, 0, *arrays


def _around(got: dict, number: int):
    """Per node its neighbours and at most as many of the nodes that name it, new ones first, drawn anew each round; ``(key, pos, known)``."""
    import numpy as np

    own, pos, _, flag = _arrays(got.get(LISTS, []), np.int32, np.int32, np.float32, bool)
    key, by, known = _arrays(got.get(NAMERS, []), np.int32, np.int32, bool)
    h = (by.astype(np.uint64) + np.uint64(number << 40)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((h, known, key)) if number < ROUNDS else np.lexsort((h, key))
    key, by, known = key[order], by[order], known[order]
    drawn = np.arange(len(key)) - np.searchsorted(key, key) < NEIGHBOURS
    key, pos, known = (np.concatenate(x) for x in ((own, key[drawn]), (pos, by[drawn]), (flag, known[drawn])))
    order = np.lexsort((pos, key))  # a node's own entry stays before its namer's
    key, pos, known = key[order], pos[order], known[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    return key[first], pos[first], known[first]


def _both(block: int, got: dict, size: int) -> Iterator:
    """The lists both ways that a search expands: a length a node of the block, and the members."""
    import numpy as np

    key, pos, _ = _around(got, ROUNDS)
    yield block, AROUND, 0, 0, np.bincount(key - block * size, minlength=size).astype(np.int32), pos


def _descend(base: DataFrame, lists: DataFrame, number: int, dim: int, blocks: int, size: int) -> DataFrame:
    """One round: neighbours of a node meet each other unless they have before."""
    sent = lists.mapInArrow(lambda b: _received(b, lambda block, got: _scattered(block, got, size)), _SENT)
    sent = _step(sent, blocks, lambda block, got: _wanted(block, got, number, size))
    sent = _step(sent.unionByName(base.where(F.col("kind") == VECTORS)), blocks, lambda block, got: _given(block, got, dim, size))
    sent = _step(sent, blocks, lambda block, got: _meet(block, got, dim, size))
    return _step(sent, blocks, lambda block, got: _merged(block, got, LISTS, NEIGHBOURS))


def _wanted(block: int, got: dict, number: int, size: int) -> Iterator:
    """The lists both ways of nodes around which something is new, and requests for the vectors that they name."""
    import numpy as np

    yield from _again(block, got, LISTS)
    key, pos, known = _around(got, number)
    keys, at = np.unique(key, return_inverse=True)
    news = np.bincount(at, ~known, len(keys)) > 0
    pos, known, lengths = pos[news[at]], known[news[at]], np.bincount(at, minlength=len(keys))[news]
    if len(pos):
        yield block, AROUND, 0, 0, lengths.astype(np.int32), pos, known
        for to, (p,) in _split(names := np.unique(pos), size, names):
            yield to, WANTED, block, 0, p


def _given(block: int, got: dict, dim: int, size: int) -> Iterator:
    """The vectors asked for, with the worst score of each one's list."""
    import numpy as np

    yield from _again(block, got, LISTS, AROUND)
    x = np.frombuffer(got[VECTORS][0][2], np.float32).reshape(-1, dim + 1)
    key, _, score, _ = _arrays(got.get(LISTS, []), np.int32, np.int32, np.float32, bool)
    key = key - block * size
    worst, full = np.full(size, -np.inf, np.float32), np.bincount(key, minlength=size) >= NEIGHBOURS
    worst[key] = score  # the last of a list
    worst[~full] = -np.inf
    for to, pos in got.get(WANTED, ()):
        pos = np.frombuffer(pos, np.int32)
        yield to, GIVEN, block, 0, pos, x[pos - block * size], worst[pos - block * size]


def _meet(block: int, got: dict, dim: int, size: int) -> Iterator:
    import numpy as np

    yield from _again(block, got, LISTS)
    if AROUND not in got:
        return
    pos, x, worst = _arrays(got[GIVEN], np.int32, np.float32, np.float32)  # in order, as blocks are
    x = x.reshape(-1, dim + 1)
    lengths, members, known = _arrays(got[AROUND], np.int32, np.int32, bool)
    members, ends = np.searchsorted(pos, members), _rows_of(lengths)
    held, total = [], 0
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        m, fresh = members[lo:hi], ~known[lo:hi]
        v = x[m]
        s = v @ v.T
        better = s > worst[m][:, None]
        better &= fresh[:, None] | fresh
        i, j = np.nonzero(better)
        if len(i) > 0:
            s, i, j = s[i, j], m[i], m[j]
            held.append((i[i != j], j[i != j], s[i != j]))
            total += len(held[-1][0])
        if total > 4 * HELD:
            held = [_kept(held)]
            total = len(held[0][0])
            if total > 2 * HELD:
                i, j, s = held[0]
                yield from ((to, FOUND, block, 0, *arrays) for to, arrays in _split(pos[i], size, pos[i], pos[j], s))
                held, total = [], 0
    if total:
        i, j, s = _kept(held)
        yield from ((to, FOUND, block, 0, *arrays) for to, arrays in _split(pos[i], size, pos[i], pos[j], s))


def _kept(held: list):
    import numpy as np

    i, j, s = (np.concatenate(c) for c in zip(*held, strict=True))
    i, j, s, _ = _best(i, j, s, np.zeros(len(i), bool), NEIGHBOURS)
    return i, j, s


def search(index: Index) -> DataFrame:
    """The beams of all nodes that ask, as far as the graph leads: ``key, pos`` and more in rows of ``_SENT``."""
    base, around, beams, dim, blocks, size = index.base, index.around, index.beams, index.dim, index.blocks, index.size
    vectors, queries = base.where(F.col("kind") == VECTORS), base.where(F.col("kind") == QUERIES)
    while beams.agg(F.sum("n")).first()[0]:
        sent = beams.mapInArrow(lambda b: _received(b, lambda block, got: _opened(block, got, size)), _SENT)
        sent = _step(sent.unionByName(around), blocks, lambda block, got: _lists_given(block, got, size))
        sent = _step(sent.unionByName(queries), blocks, lambda block, got: _asking(block, got, dim, size))
        sent = _step(sent.unionByName(vectors), blocks, lambda block, got: _answered(block, got, dim, size))
        beams = table(_step(sent, blocks, lambda block, got: _merged(block, got, BEAMS, BEAM)), "beams")
    return beams


def _opened(block: int, got: dict, size: int) -> Iterator:
    """Beams, all expanded now, what they expand, and requests for the lists of those nodes."""
    import numpy as np

    key, pos, score, flag = _arrays(got[BEAMS], np.int32, np.int32, np.float32, bool)
    yield block, BEAMS, 0, 0, key, pos, score, np.ones(len(key), bool)
    if not flag.all():
        yield block, WENT, 0, 0, key[~flag], pos[~flag]
        for to, (p,) in _split(names := np.unique(pos[~flag]), size, names):
            yield to, WANTED, block, 0, p


def _lists_given(block: int, got: dict, size: int) -> Iterator:
    import numpy as np

    yield from _again(block, got, BEAMS, WENT)
    lengths, members = _arrays(got[AROUND], np.int32, np.int32) if AROUND in got else np.zeros((2, size), np.int32)
    ends = _rows_of(lengths)
    for to, pos in got.get(WANTED, ()):
        pos = np.frombuffer(pos, np.int32)
        at = pos - block * size
        yield to, GIVEN, block, 0, pos, lengths[at], members[_places(ends[at], lengths[at])]


def _places(starts, lengths):
    """The places of lists of some ``lengths`` that begin at ``starts``, one list after the other."""
    import numpy as np

    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _asking(block: int, got: dict, dim: int, size: int) -> Iterator:
    """Each query to the blocks of nodes that it has not in its beam and that the expanded ones name."""
    import numpy as np

    yield from _again(block, got, BEAMS)
    if WENT not in got:
        return
    names, lengths, members = _arrays(got[GIVEN], np.int32, np.int32, np.int32)  # in order, as blocks are
    starts = _rows_of(lengths)[:-1]
    went, node = _arrays(got[WENT], np.int32, np.int32)
    own, has, score, _ = _arrays(got[BEAMS], np.int32, np.int32, np.float32, bool)
    keys, q = _arrays(got[QUERIES], np.int32, np.float32)
    q = q.reshape(-1, dim + 1)
    node = np.searchsorted(names, node)
    held = []  # (query, worst, nodes)
    for key, lo, hi in zip(*_runs(went), strict=True):
        new = np.unique(members[_places(starts[node[lo:hi]], lengths[node[lo:hi]])])
        a, b = np.searchsorted(own, [key, key + 1])
        new = new[~np.isin(new, has[a:b])]
        held.append((np.searchsorted(keys, key), score[b - 1] if b - a >= BEAM else -np.inf, new))
        if len(held) == 256:
            yield from _questions(block, held, keys, q, size)
            held = []
    yield from _questions(block, held, keys, q, size)


def _runs(key):
    """Equal numbers that follow each other: the number, where they begin and end."""
    import numpy as np

    names, starts = np.unique(key, return_index=True)
    return names, starts, np.append(starts[1:], len(key))[: len(names)]


def _questions(block: int, held: list, keys, q, size: int) -> Iterator:
    import numpy as np

    if not held:
        return
    rows, worst = np.array([r for r, _, _ in held]), np.array([w for _, w, _ in held], np.float32)
    ids, of = np.concatenate([n for _, _, n in held]), np.repeat(np.arange(len(held)), [len(n) for _, _, n in held])
    for to, (p, o) in _split(ids, size, ids, of):
        some, lengths = np.unique(o, return_counts=True)
        yield to, ASKED, block, 0, keys[rows[some]], lengths.astype(np.int32), p, q[rows[some]], worst[some]


def _answered(block: int, got: dict, dim: int, size: int) -> Iterator:
    """The nodes asked about that enter a query's beam."""
    import numpy as np

    yield from _again(block, got, BEAMS)
    x = np.frombuffer(got[VECTORS][0][2], np.float32).reshape(-1, dim + 1) if VECTORS in got else None
    for to, *arrays in got.get(ASKED, ()):
        key, lengths, pos, q, worst = (np.frombuffer(a, kind) for a, kind in zip(arrays, (np.int32, np.int32, np.int32, np.float32, np.float32), strict=True))
        q, ends = q.reshape(-1, dim + 1), _rows_of(lengths)
        s = np.concatenate([x[pos[lo:hi] - block * size] @ row for row, lo, hi in zip(q, ends[:-1], ends[1:], strict=True)])
        good = s > np.repeat(worst, lengths)
        if good.any():
            yield to, FOUND, block, 0, *_best(np.repeat(key, lengths)[good], pos[good], s[good], np.zeros(good.sum(), bool), BEAM)[:3]


def _flat(batches: Iterator, top: int) -> Iterator:
    """A row a query and one of its ``top`` best nodes."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for arrays in zip(*(b.column(c) for c in "ab"), strict=True):
            key, pos = (np.frombuffer(x.as_buffer(), np.int32) for x in arrays)
            best = np.arange(len(key)) - np.searchsorted(key, key) < top
            yield pa.RecordBatch.from_arrays([pa.array(x[best].astype(np.int64)) for x in (key, pos)], names=["key", "pos"])


def _ranked(index: Index, asked: DataFrame, beams: DataFrame, k: int) -> DataFrame:
    """The beams' best by inner products in double precision of the original vectors, with the ids of equal vectors, for ``asked(query_id, key)``."""
    near = beams.select("a", "b").mapInArrow(lambda b: _flat(b, 2 * k + 1), "key bigint, pos bigint")
    near = near.join(index.nodes.select("pos", F.col("v").alias("x"), "ids"), "pos").join(index.nodes.where("q IS NOT NULL").select(F.col("pos").alias("key"), "v"), "key")
    score = F.aggregate(F.zip_with("v", "x", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    near = near.select("key", score.alias("score"), "ids").join(asked, "key")
    near = near.select("key", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    w = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
