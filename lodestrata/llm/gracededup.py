"""Exact deduplication by Grace hashing.

Texts equal byte for byte form one class. Each map task first folds its own copies in
a bounded open-addressing table (so a text that fills a third of the corpus crosses
the shuffle at most a few times per task), the shuffle deals the folded rows out by
digest, and each reduce task partitions its rows recursively into spill files until a
bucket fits an open-addressing table that compares complete contents.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.scratch import place, shielded, table, unshielded

FOLDED = "h bigint, content binary, keep_id bigint, n bigint"
CLASSES = "digest binary, content binary, keep_id bigint, group_size bigint"
FANOUT = 16
MAX_DEPTH = 6


def _digest(content: bytes, digest_bytes: int) -> bytes:
    return hashlib.sha256(content).digest()[:digest_bytes]


def _slot_hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8].ljust(8, b"\0"), "little", signed=True)


class OpenTable:
    """Linear probing over (hash, content); equal only if the complete contents are equal."""

    def __init__(self, size: int = 64):
        self.slots = [-1] * size
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keeps: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def _seat(self, h: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = (h * 0x9E3779B97F4A7C15 >> 20) & mask
        while (e := self.slots[at]) >= 0:
            if content is not None and self.hashes[e] == h and self.contents[e] == content:
                return at
            at = (at + 1) & mask
        return at

    def find(self, h: int, content: bytes) -> int:
        return self.slots[self._seat(h, content)]

    def add(self, h: int, content: bytes, keep: int | None, n: int) -> None:
        at = self._seat(h, content)
        if (e := self.slots[at]) >= 0:
            self.counts[e] += n
            if keep is not None and (self.keeps[e] is None or keep > self.keeps[e]):
                self.keeps[e] = keep
            return
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.keeps.append(keep)
        self.counts.append(n)
        self.bytes += len(content) + 120
        if len(self.hashes) * 5 > len(self.slots) * 3:
            self.slots = [-1] * (2 * len(self.slots))
            for e, kept in enumerate(self.hashes):
                self.slots[self._seat(kept, None)] = e


def _folded(t: OpenTable) -> Iterator[pa.RecordBatch]:
    step, at = 0, 0
    for i, c in enumerate(t.contents):
        step += len(c)
        if step > 8 << 20 or i + 1 == len(t.contents):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t.hashes[at : i + 1], pa.int64()),
                    pa.array(t.contents[at : i + 1], pa.binary()),
                    pa.array(t.keeps[at : i + 1], pa.int64()),
                    pa.array(t.counts[at : i + 1], pa.int64()),
                ],
                names=["h", "content", "keep_id", "n"],
            )
            step, at = 0, i + 1


def _fold(memory: int, digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = OpenTable()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                t.add(_slot_hash(_digest(text, digest_bytes)), text, doc, 1)
                if t.bytes > memory:
                    yield from _folded(t)
                    t = OpenTable()
        yield from _folded(t)

    return run


_HEAD = struct.Struct("<qqqI?")


class _Spill:
    """One bucket's rows in a local file of the task's own, removed when read."""

    def __init__(self, folder: str):
        fd, self.path = tempfile.mkstemp(dir=folder)
        self.file = os.fdopen(fd, "wb", buffering=1 << 18)
        self.bytes = 0

    def put(self, h: int, content: bytes, keep: int | None, n: int) -> None:
        self.file.write(_HEAD.pack(h, keep or 0, n, len(content), keep is None))
        self.file.write(content)
        self.bytes += len(content) + 120

    def rows(self) -> Iterator[tuple[int, bytes, int | None, int]]:
        self.file.close()
        with open(self.path, "rb", buffering=1 << 20) as f:
            os.unlink(self.path)
            while head := f.read(_HEAD.size):
                h, keep, n, size, none = _HEAD.unpack(head)
                yield h, f.read(size), None if none else keep, n


def _bucket(h: int, depth: int) -> int:
    return ((h * 0xFF51AFD7ED558CCD) >> (8 + 4 * depth)) & (FANOUT - 1)


def _grace(rows, depth: int, memory: int, folder: str) -> Iterator[tuple[OpenTable, bool]]:
    """Tables that together hold each distinct content exactly once; True: hashes may span tables."""
    t = OpenTable()
    parts: list[_Spill] | None = None
    over: _Spill | None = None
    for h, content, keep, n in rows:
        if parts is not None:
            parts[_bucket(h, depth)].put(h, content, keep, n)
        elif over is not None and t.find(h, content) < 0:
            over.put(h, content, keep, n)
        else:
            t.add(h, content, keep, n)
            if t.bytes > memory and over is None:
                if depth >= MAX_DEPTH:  # one hash value only: fill, pass over, repeat
                    over = _Spill(folder)
                else:
                    parts = [_Spill(folder) for _ in range(FANOUT)]
                    for e, kept in enumerate(t.hashes):
                        parts[_bucket(kept, depth)].put(kept, t.contents[e], t.keeps[e], t.counts[e])
                    t = OpenTable()
    if parts is not None:
        for p in parts:
            yield from _grace(p.rows(), depth + 1, memory, folder)
        return
    yield t, over is not None or depth > MAX_DEPTH
    if over is not None:
        yield from _grace(over.rows(), MAX_DEPTH + 1, memory, folder)


def _reduce(memory: int, digest_bytes: int):
    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            for t, split in _grace(rows(batches), 0, memory, folder):
                by_hash: dict[int, int] = {}
                for h in t.hashes:
                    by_hash[h] = by_hash.get(h, 0) + 1
                for at in range(0, len(t.hashes), 20_000):
                    to = min(at + 20_000, len(t.hashes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([_digest(c, digest_bytes) for c in t.contents[at:to]], pa.binary()),
                            pa.array([t.contents[e] if split or by_hash[t.hashes[e]] > 1 else None for e in range(at, to)], pa.binary()),
                            pa.array(t.keeps[at:to], pa.int64()),
                            pa.array(t.counts[at:to], pa.int64()),
                        ],
                        names=["digest", "content", "keep_id", "group_size"],
                    )

    return run


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 48 << 20, digest_bytes: int = 32) -> DataFrame:
    """One row per distinct text: digest, keep_id (largest id), group_size; content where a digest is shared."""
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    folded = rows.mapInArrow(_fold(memory, digest_bytes), FOLDED)
    return folded.repartition("h").mapInArrow(_reduce(memory, digest_bytes), CLASSES)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 48 << 20, digest_bytes: int = 32) -> DataFrame:
    """Every input row with ``keep_id, group_size, kept, text_sha256`` added.

    A null text counts as empty; nothing is normalised. Of equal texts the row with the
    largest id stays. A null id never wins over a number; if all ids of a class are null,
    ``keep_id`` is null and all its rows stay. Rows that repeat the winning id are all
    ``kept`` (they are one document). Columns of the input with these names are replaced.
    An empty table gives an empty table. Contents that share a digest are told apart by
    the contents themselves (``digest_bytes`` below 32 is for tests of that path).
    """
    classes = table(text_classes(docs, id_col, text_col, memory, digest_bytes), "classes")
    own_id = F.col(place(docs, id_col)).cast("bigint")
    body = F.coalesce(F.col(place(docs, text_col)), F.lit("")).cast("binary")
    left = shielded(docs).withColumn("text_sha256", F.sha2(body, 256))
    left = left.withColumn("digest", F.substring(F.unhex("text_sha256"), 1, digest_bytes))
    plain = classes.where("content IS NULL").drop("content")
    out = left.join(plain, "digest", "left")
    shared = classes.where("content IS NOT NULL")
    if not shared.isEmpty():  # a digest with several contents: those join by content as well
        hard = shared.select("digest", "content", F.col("keep_id").alias("k"), F.col("group_size").alias("g"))
        out = left.withColumn("content", body).join(plain, "digest", "left").join(hard, ["digest", "content"], "left")
        out = out.withColumn("keep_id", F.when(F.col("g").isNull(), F.col("keep_id")).otherwise(F.col("k"))).withColumn("group_size", F.coalesce("g", "group_size"))
    out = out.withColumn("kept", F.col("keep_id").eqNullSafe(own_id))
    return unshielded(out, docs.columns, "keep_id", "group_size", "kept", "text_sha256")
