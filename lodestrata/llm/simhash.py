"""SimHash near-duplicates by vantage-point trees.

Fingerprints are collapsed to distinct values first, so exact copies cost one row. A
top tree over a bounded sample cuts Hamming space into shards: every inner node holds
a vantage point and the distance rings of its children. A fingerprint lives in one
shard and visits those others whose rings its radius overlaps (triangle inequality),
so every linked pair meets in at least one shard. Inside a shard a local tree answers
the queries in bulk, and only a spanning forest of the links found leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.forest import Forest
from lodestrata.llm.scratch import sampled, table

SAMPLE = 32_768
SHARD_ROWS = 65_536
MAX_SHARDS = 4_096
RINGS = 8
LEAF = 256
SEED = 42


def fingerprint(text: str | bytes | None, words: int = 4) -> int:
    """Majority bits of the XXH64 values of all word shingles; zero for a text without words."""
    raw = text.encode() if isinstance(text, str) else text or b""
    parts = raw.lower().split()  # bytes: only A-Z change, and only \x09-\x0D and \x20 part words
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(parts) - words + 1)
    lo, hi = starts[:last].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    h64 = xxhash.xxh64_intdigest
    for at in range(0, last, 1 << 16):
        to = min(last, at + (1 << 16))
        h = np.fromiter((h64(joined[s:e], SEED) for s, e in zip(lo[at:to], hi[at:to], strict=True)), dtype=np.uint64, count=to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > last, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.fromiter((fingerprint(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id bigint, fp bigint")


def _distance(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v).astype(np.int64)


def grow(points: np.ndarray, leaf: int) -> dict:
    """A tree over ``points``; leaves hold positions in ``at``. Nodes: vantage point and (lo, hi, child) rings."""

    def node(at: np.ndarray) -> dict:
        if at.size <= leaf:
            return {"at": at}
        v = points[at[at.size // 2]]
        d = _distance(points[at], v)
        cuts = np.unique(np.quantile(d, np.linspace(0, 1, RINGS + 1)[1:-1], method="lower"))
        ring = np.searchsorted(cuts, d, side="left")  # ring k: cuts[k-1] < d <= cuts[k]
        kids = [(int(d[ring == k].min()), int(d[ring == k].max()), at[ring == k]) for k in np.unique(ring)]
        if len(kids) == 1:
            return {"at": at}
        return {"v": v, "cuts": cuts, "kids": [(lo, hi, node(x)) for lo, hi, x in kids]}

    return node(np.arange(points.size))


def search(tree: dict, queries: np.ndarray, radius: int, found) -> None:
    """Calls ``found(query positions, leaf)`` for each leaf that the triangle bounds leave open."""

    def visit(n: dict, q: np.ndarray) -> None:
        if not q.size:
            return
        if "at" in n:
            found(q, n["at"])
            return
        d = _distance(queries[q], n["v"])
        for lo, hi, kid in n["kids"]:
            visit(kid, q[(d >= lo - radius) & (d <= hi + radius)])

    visit(tree, np.arange(queries.size))


def top_tree(sample: np.ndarray, shards: int) -> tuple[dict, int]:
    """Rings without gaps for points outside the sample; leaves are numbered in ``shard``."""
    count = 0

    def open_up(n: dict) -> dict:
        nonlocal count
        if "at" in n:
            count += 1
            return {"shard": count - 1}
        cuts = [-1, *(int(hi) for _, hi, _ in n["kids"][:-1]), 64]
        return {"v": n["v"], "kids": [(cuts[k] + 1, cuts[k + 1], open_up(kid)) for k, (_, _, kid) in enumerate(n["kids"])]}

    return open_up(grow(sample, max(1, -(-sample.size // shards)))), count


def _reach(tree: dict, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, shard) of every shard that lies within ``radius`` of a fingerprint."""
    at, to = [], []

    def visit(n: dict, q: np.ndarray) -> None:
        if not q.size:
            return
        if "shard" in n:
            at.append(q)
            to.append(np.full(q.size, n["shard"], dtype=np.int32))
            return
        d = _distance(fp[q], n["v"])
        for lo, hi, kid in n["kids"]:
            visit(kid, q[(d >= lo - radius) & (d <= hi + radius)])

    visit(tree, np.arange(fp.size))
    return (np.concatenate(at), np.concatenate(to)) if at else (np.empty(0, np.int64), np.empty(0, np.int32))


def _deal(tree: dict, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, every.size, 50_000):
                fp = every[k : k + 50_000]
                at, home = _reach(tree, fp, 0)  # rings leave no gap and don't overlap: one shard each
                own = np.empty(fp.size, dtype=np.int32)
                own[at] = home
                at, to = _reach(tree, fp, radius)
                keep = to >= own[at]  # of a pair's two shards, the later one sees both
                at, to = at[keep], to[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(to == own[at]), pa.array(fp[at].view(np.int64))], names=["shard", "home", "fp"]
                )

    return run


def shard_links(home: np.ndarray, guests: np.ndarray, radius: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as fingerprint pairs) of all links home-home and guest-home."""
    every = np.concatenate([home, guests])
    forest = Forest(every.size)

    def found(q: np.ndarray, at: np.ndarray) -> None:
        step = max(1, cells // at.size)
        for k in range(0, q.size, step):
            i, j = np.nonzero(np.bitwise_count(every[q[k : k + step], None] ^ home[None, at]) <= radius)
            forest.union(q[k : k + step][i], at[j])

    search(grow(home, LEAF), every, radius, found)
    a, b = forest.edges()
    return every[a], every[b]


def _match(radius: int):
    def links(home, guests):
        a, b = shard_links(np.concatenate(home), np.concatenate(guests) if guests else np.empty(0, np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, guests = None, [], []
        for b in batches:  # sorted by shard
            shard = b.column(0).to_numpy(zero_copy_only=False)
            own = b.column(1).to_numpy(zero_copy_only=False)
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in np.unique(shard):
                here = shard == s
                if s != now:
                    if home:
                        yield links(home, guests)
                    now, home, guests = s, [], []
                if (here & own).any():
                    home.append(fp[here & own])
                if (here & ~own).any():
                    guests.append(fp[here & ~own])
        if home:
            yield links(home, guests)

    return run


def linked(distinct: DataFrame, radius: int = 4, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(a, b)``: links that connect the same fingerprints as all pairs within ``radius`` do.

    The sample (at most about ``sample`` values, chosen by hash) only places the top
    tree's rings; every fingerprint is dealt out and compared.
    """
    n = distinct.count()
    shards = min(MAX_SHARDS, max(1, -(-n // shard_rows)))
    picked = sampled(distinct, F.xxhash64("fp"), n, sample)
    points = np.sort(np.array([r[0] for r in picked.limit(2 * sample).collect()], dtype=np.int64)).view(np.uint64)
    points = points[np.argsort(points * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
    tree, count = top_tree(points, shards) if points.size else ({"shard": 0}, 1)
    dealt = distinct.select("fp").mapInArrow(_deal(tree, radius), "shard int, home boolean, fp bigint")
    return dealt.repartition(count, "shard").sortWithinPartitions("shard").mapInArrow(_match(radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``id, fp, component_id`` per input row; component_id is the least id reachable over links.

    A null text counts as empty; texts without words have fingerprint zero and link like
    any other. Null ids never name a component unless all its ids are null. Repeated ids
    and rows are kept as they are. An empty table gives an empty table.
    """
    marked = table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = table(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = components(linked(distinct, radius, sample, shard_rows))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = table(named, "named")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "label").select("fp", "component_id")
    return marked.join(by_fp, "fp", "left").select("id", "fp", "component_id")
