"""Texts that share too few shingles with all others to have a near copy.

A text of ``n`` shingles whose similarity to another is 4/5 or more has at most
``n - ceil(4n/5)`` shingles that the other lacks. So of any of its shingles no more than
those may be in no other text. Texts send the third of their shingles whose hashes are
smallest, which two texts choose alike; texts of few shingles send all, and so do those
that are large enough to be their copies. What is counted as shared is so in at least
those cases: collisions keep a text, none loses one.

Shingles travel as sorted slots of a part of the hash range, a row a part and chunk of
texts, with the places of their texts in the chunk: some four bytes each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text a part; their sent shingles fill its slots to a fiftieth or so.
PART_BYTES = 1 << 25
SLOT_BITS = 27
#: Sent shingles and texts of a chunk at most, about.
CHUNK, CHUNK_TEXTS = 1 << 20, 1 << 15
#: Texts of fewer shingles are judged by all of them, others by those up to LIMIT.
SMALL, LIMIT = 128, np.uint64((1 << 64) // 3)
#: The place of a text that is not judged by a shingle.
SEEN = 0xFFFF

_SENT = "part int, chunk bigint, slots binary, places binary, nodes array<bigint>, need array<int>"
_SHARED = "chunk bigint, places binary, nodes array<bigint>, need array<int>"


def lone(texts: DataFrame, sets: Callable[[Iterator], Iterator]) -> DataFrame:
    """``node`` of those ``texts(node, t)`` that can't have a near copy; ``sets`` turns batches of texts into ``(node, hashes)``.

    Hashes are sorted and distinct. Texts without shingles aren't among the result; rows
    that repeat a text keep each other.
    """
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = min(1 << 20, max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES)))
    sent = texts.select("node", "t").mapInArrow(lambda b: _sent(sets(b), parts), _SENT)
    sent = sent.repartition(parts, "part").sortWithinPartitions("part")
    shared = sent.mapInArrow(_shared, _SHARED).repartition("chunk").sortWithinPartitions("chunk")
    return shared.mapInArrow(lambda b: _lone(b, parts), "node bigint")


def _sent(sets: Iterator, parts: int) -> Iterator[pa.RecordBatch]:
    nodes, need, keys, size = [], [], [], 0
    for node, h in sets:
        if not h.size:
            continue
        judged = h.size if h.size < SMALL else int(np.searchsorted(h, LIMIT))
        own = h if 4 * h.size <= 5 * SMALL else h[:judged]
        place = np.full(own.size, SEEN, np.uint64)
        place[:judged] = len(nodes)
        part = ((own & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)
        slot = (own >> np.uint64(32)) & np.uint64((1 << SLOT_BITS) - 1)
        keys.append((part << np.uint64(SLOT_BITS + 16)) | (slot << np.uint64(16)) | place)
        nodes.append(node)
        need.append(judged - (h.size - -(-4 * h.size // 5)))
        size += own.size
        if size >= CHUNK or len(nodes) >= CHUNK_TEXTS:
            yield _chunk(nodes, need, keys, parts)
            nodes, need, keys, size = [], [], [], 0
    if nodes:
        yield _chunk(nodes, need, keys, parts)


def _chunk(nodes: list, need: list, keys: list, parts: int) -> pa.RecordBatch:
    """A row a part; one of them has the chunk's texts too. The chunk is named by its texts, so a task that runs again repeats it."""
    key = np.sort(np.concatenate(keys))
    places, slots = (key & np.uint64(0xFFFF)).astype(np.uint16), (key >> np.uint64(16)).astype(np.int64)
    ends = np.searchsorted(slots, np.arange(parts + 1, dtype=np.int64) << SLOT_BITS)
    packed, placed = [], []
    for k in range(parts):
        lo, hi = ends[k], ends[k + 1]
        packed.append(_packed(slots[lo:hi] & ((1 << SLOT_BITS) - 1)))
        placed.append(places[lo:hi].tobytes())
    chunk = xxhash.xxh64_intdigest(np.array(nodes, np.int64).tobytes()) >> 1
    home = [[] if k != chunk % parts else None for k in range(parts)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(parts), pa.int32()),
            pa.array([chunk] * parts, pa.int64()),
            pa.array(packed, pa.binary()),
            pa.array(placed, pa.binary()),
            pa.array([nodes if x is None else x for x in home], pa.list_(pa.int64())),
            pa.array([need if x is None else x for x in home], pa.list_(pa.int32())),
        ],
        names=["part", "chunk", "slots", "places", "nodes", "need"],
    )


def _packed(slots: np.ndarray) -> bytes:
    """Differences of sorted slots, all their low bytes first; high bytes are zeros that compress to nothing."""
    steps = np.diff(slots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(steps.T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u4").ravel(), dtype=np.int64)


def _grouped(batches: Iterator, key: str) -> Iterator[list]:
    """The rows of a key, as one-row slices, the batches being ordered by it."""
    now, rows = None, []
    for b in batches:
        for k, at in enumerate(b.column(key).to_pylist()):
            if rows and at != now:
                yield rows
                rows = []
            now = at
            rows.append(b.slice(k, 1))
    if rows:
        yield rows


def _shared(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """For each row the places of those of its shingles whose slot another one has."""
    for rows in _grouped(batches, "part"):
        slots = [_unpacked(r.column("slots")[0].as_py()) for r in rows]
        ends = np.cumsum([0, *[s.size for s in slots]])
        key = np.sort((np.concatenate(slots).astype(np.uint64) << np.uint64(32)) | np.arange(ends[-1], dtype=np.uint64))
        same = (key[1:] >> np.uint64(32)) == (key[:-1] >> np.uint64(32))
        both = np.zeros(key.size, bool)
        both[1:] |= same
        both[:-1] |= same
        held = np.zeros(key.size, bool)
        held[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)] = both
        for k, r in enumerate(rows):
            places = np.frombuffer(r.column("places")[0].as_py(), np.uint16)[held[ends[k] : ends[k + 1]]]
            found = pa.array([np.sort(places[places != SEEN]).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([r.column("chunk"), found, r.column("nodes"), r.column("need")], names=["chunk", "places", "nodes", "need"])


def _lone(batches: Iterator, parts: int) -> Iterator[pa.RecordBatch]:
    """The texts of a chunk with too few shared shingles; none of a chunk whose rows aren't all there."""
    for rows in _grouped(batches, "chunk"):
        nodes = np.array([x for r in rows for x in r.column("nodes")[0].as_py()], np.int64)
        need = np.array([x for r in rows for x in r.column("need")[0].as_py()], np.int64)
        if len(rows) != parts or not nodes.size or nodes.size > CHUNK_TEXTS:
            continue
        counts = np.zeros(SEEN + 1, np.int64)
        for r in rows:
            counts += np.bincount(np.frombuffer(r.column("places")[0].as_py(), np.uint16), minlength=SEEN + 1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[counts[: nodes.size] < need])], names=["node"])
