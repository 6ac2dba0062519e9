"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best fit. Documents (pieces) and gaps of open sequences are range-sorted
together by size; in that order a piece opens a bracket and a gap closes one, so a sweep
gives each gap the largest piece that fits it and that no smaller gap takes. Every range
is swept by its own task. What stays open in a range is matched across ranges by rank,
from a count of open pieces and gaps a range, so the result is that of one sweep over the
whole order and doesn't depend on how the ranges were cut. Matched pieces are seated,
gaps shrink, and the next superstep follows. Pieces that exceed every gap open as many
sequences as their lengths fill.

Large pieces go first: classes of sizes fall by a factor of four, and small ones fill what
larger ones left. Where pieces outnumber gaps a gap is swept as several slots of the
class's largest size, so a superstep seats many pieces a sequence and the number of
supersteps is bounded by the sequence length, not by the corpus. A class that fits one
task's range runs its remaining supersteps there.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import table

END_ID = 0
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one task sweeps, and the most ranges.
TASK_ROWS, MAX_RANGES = 50_000, 20_000
CLASS = 4
PIECE, GAP, SEAT = 0, 1, 2


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _ranks(path: str):
    """``(encoding, added tokens)`` of a byte-level BPE file whose ids follow its merge order, else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout"):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(set(made)):
        return None
    import tiktoken

    to_byte, added = _byte_alphabet(), [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as little-endian uint32.

    Files of plain byte-level ranks are encoded by the same merges in a faster library;
    texts that spell an added token, or whose runs of white space exceed that library's
    limits, and all other files go through the tokenizer itself.
    """
    fast = _ranks(path)
    if fast and not any(t in text for t in fast[1]):
        try:
            return fast[0].encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except ValueError:  # a run of white space too long for its pattern matcher
            pass
    return np.asarray(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, pid bigint"
ROWS = "kind int, id bigint, v int, other bigint, part int, rank bigint"


def _cut_up(path: str, seq_len: int):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, end = TaskContext.get().partitionId() << 40, np.asarray([END_ID], dtype="<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = token_ids(path, text.as_py() or "").tobytes() + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    size = (n % seq_len or seq_len) if start == 0 and n > seq_len else min(seq_len, n - start)
                    rows.append((doc.as_py(), piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), pid))
                    start, piece, pid = start + size, piece + 1, pid + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document, numbered by ``pid``."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(_cut_up(tokenizer, seq_len), PIECES)


# ---- one superstep


def brackets(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (piece, gap) that match in a sorted order, given where the gaps are."""
    after = np.cumsum(np.where(gap, -1, 1))
    level = np.where(gap, after + 1, after)
    order = np.argsort(level, kind="stable")
    level, closes = level[order], gap[order]
    hit = (level[:-1] == level[1:]) & ~closes[:-1] & closes[1:]
    return order[:-1][hit], order[1:][hit]


def _batch(kind, id_, v, other, part=-1, rank=None) -> pa.RecordBatch:
    n = len(id_)
    columns = [
        pa.array(np.broadcast_to(np.int32(kind), n) if np.ndim(kind) == 0 else kind, pa.int32()),
        pa.array(id_, pa.int64()),
        pa.array(v, pa.int32()),
        pa.array(other, pa.int64()),
        pa.array(np.full(n, part, dtype=np.int32)),
        pa.array(np.full(n, -1, dtype=np.int64) if rank is None else rank, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])


def _gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """kind, id, v, other of all rows of the task, which a range bounds."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns[:4]] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.empty(0, np.int64)] * 4


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seats and shrunken gaps of one range, and what stays open in it, by rank."""
    kind, id_, v, other = _gathered(batches)
    if not id_.size:
        return
    order = np.lexsort((other, id_, kind, v))
    kind, id_, v, other = kind[order], id_[order], v[order], other[order]
    p, g = brackets(kind == GAP)
    yield _batch(SEAT, id_[p], v[p], id_[g])
    yield _batch(GAP, id_[g], v[g] - v[p], other[g])
    open_ = np.ones(id_.size, dtype=bool)
    open_[p] = open_[g] = False
    part = TaskContext.get().partitionId()
    for k in (PIECE, GAP):
        at = np.flatnonzero(open_ & (kind == k))
        yield _batch(k, id_[at], v[at], other[at], part, np.arange(at.size))


def across(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Matches between ranges from ``(part, open gaps, open pieces)``, ascending.

    Rows ``gap part, first gap rank, piece part, last piece rank, how many, first match``:
    gaps take open pieces of earlier ranges from the largest down. At most two rows a range.
    """
    out, stack, match = [], [], 0
    for part, gaps, open_ in counts:
        at = 0
        while at < gaps and stack:
            below, left = stack.pop()
            n = min(gaps - at, left)
            out.append((part, at, below, left - 1, n, match))
            at, match = at + n, match + n
            if n < left:
                stack.append((below, left - n))
        if open_:
            stack.append((part, open_))
    return np.asarray(out, dtype=np.int64).reshape(-1, 6)


def _numbered(found: np.ndarray):
    """Open rows with the number of their match across ranges, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {}
        for kind, part, low in ((GAP, found[:, 0], found[:, 1]), (PIECE, found[:, 2], found[:, 3] - found[:, 4] + 1)):
            order = np.lexsort((low, part))
            sides[kind] = (part[order] << 40) + low[order], order
        for b in batches:
            kind, part, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("kind", "part", "rank"))
            match = np.full(kind.size, -1, dtype=np.int64)
            for k, (starts, order) in sides.items():
                here = np.flatnonzero(kind == k)
                at = np.searchsorted(starts, (part[here].astype(np.int64) << 40) + rank[here], side="right") - 1
                here, at = here[at >= 0], at[at >= 0]
                s = found[order[at]]
                step = rank[here] - s[:, 1] if k == GAP else s[:, 3] - rank[here]
                inside = (part[here] == (s[:, 0] if k == GAP else s[:, 2])) & (step >= 0) & (step < s[:, 4])
                match[here[inside]] = s[inside, 5] + step[inside]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(match)], names=[*b.schema.names, "match"])

    return run


def _slots(gaps: DataFrame, hi: int, each: int) -> DataFrame:
    """Gaps as up to ``each`` slots of ``hi``, the last with the rest."""
    if each == 1:
        return gaps
    k = F.greatest(F.lit(1), F.least(F.lit(each), F.floor(F.col("v") / hi))).cast("int")
    slot = gaps.withColumn("k", k).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cap = F.when(F.col("other") < F.col("k") - 1, hi).otherwise(F.col("v") - (F.col("k") - 1) * hi)
    return slot.select("kind", "id", cap.cast("int").alias("v"), F.col("other").cast("bigint").alias("other"))


def _superstep(spread: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """``(pieces and gaps after it, seats)`` of a sweep over ``spread(kind, id, v, other)``."""
    rows = ["kind", "id", "v", "other"]
    swept = table(spread.repartitionByRange(ranges, "v", "kind", "id", "other").mapInArrow(_sweep, ROWS), "pack-sweep")
    open_ = swept.where("rank >= 0")
    counts = open_.groupBy("part").agg(F.sum(F.when(F.col("kind") == GAP, 1).otherwise(0)).alias("gaps"), F.sum(F.when(F.col("kind") == PIECE, 1).otherwise(0)).alias("open")).collect()  # a row a range
    found = across(sorted((r["part"], r["gaps"], r["open"]) for r in counts))
    done = swept.where("rank < 0").select(*rows)
    if len(found):
        numbered = open_.mapInArrow(_numbered(found), f"{ROWS}, match bigint")
        pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        met = numbered.where("match >= 0").groupBy("match").agg(pick(PIECE, "id").alias("p"), pick(PIECE, "v").alias("size"), pick(GAP, "id").alias("g"), pick(GAP, "v").alias("cap"), pick(GAP, "other").alias("slot"))
        met = met.selectExpr(f"stack(2, {SEAT}, p, size, g, {GAP}, g, cap - size, slot) AS (kind, id, v, other)")
        joined = table(met.unionByName(numbered.where("match < 0").select(*rows)), "pack-across")
        done = done.unionByName(joined)
    else:
        done = done.unionByName(open_.select(*rows))
    return done.where(f"kind = {PIECE} OR kind = {GAP} AND v > 0"), done.where(f"kind = {SEAT}")


# ---- supersteps in one task


def _opened_for(sizes: np.ndarray, counts: np.ndarray, seq_len: int) -> int:
    """Sequences to open for pieces that no gap holds."""
    return max(-(-int((sizes * counts).sum()) // seq_len), int(counts[2 * sizes > seq_len].sum()))


def finish(pid: np.ndarray, size: np.ndarray, seq: np.ndarray, gap: np.ndarray, opened: int, seq_len: int, hi: int, last: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All supersteps of the classes from ``hi`` down to those above ``last``: seats (pid, size, seq), and gaps (seq, gap) after them."""
    seats: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(seq, kind="stable")
    seq, gap = seq[order], gap[order].astype(np.int64)
    while pid.size and hi > last:
        mine = size > hi // CLASS
        p, s = pid[mine], size[mine].astype(np.int64)
        while p.size:
            over = s > gap.max(initial=0)
            new = _opened_for(s[over], np.ones(int(over.sum()), dtype=np.int64), seq_len)
            seq, gap = np.concatenate([seq, np.arange(opened, opened + new)]), np.concatenate([gap, np.full(new, seq_len)])
            opened += new
            active = np.flatnonzero(gap >= s.min())
            k = np.clip(gap[active] // hi, 1, -(-p.size // active.size))
            owner, ends = np.repeat(active, k), np.cumsum(k)
            slot, cap = np.arange(owner.size) - np.repeat(ends - k, k), np.full(owner.size, hi)
            cap[ends - 1] = gap[active] - (k - 1) * hi
            v, kind = np.concatenate([s, cap]), np.repeat([PIECE, GAP], [p.size, owner.size])
            at = np.lexsort((np.concatenate([np.zeros(p.size, np.int64), slot]), np.concatenate([p, seq[owner]]), kind, v))
            i, j = brackets(kind[at] == GAP)
            i, j = at[i], owner[at[j] - p.size]
            seats.append((p[i], s[i], seq[j]))
            np.subtract.at(gap, j, s[i])
            stay = np.ones(p.size, dtype=bool)
            stay[i] = False
            p, s = p[stay], s[stay]
        pid, size = pid[~mine], size[~mine]
        seq, gap = seq[gap > 0], gap[gap > 0]
        hi //= CLASS
    none = np.empty(0, np.int64)
    return *(np.concatenate(c) for c in zip((none, none, none), *seats, strict=True)), seq, gap


def _finished(opened: int, seq_len: int, hi: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, id_, v, _ = _gathered(batches)
        p, g = kind == PIECE, kind == GAP
        if p.any():
            pid, size, to, seq, gap = finish(id_[p], v[p], id_[g], v[g], opened, seq_len, hi, last)
            yield _batch(SEAT, pid, size, to)
            yield _batch(GAP, seq, gap, np.zeros(seq.size, np.int64))

    return run


# ---- the whole plan


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _histogram(rows: DataFrame) -> dict[int, dict[int, int]]:
    """Counts by kind and size: at most twice the sequence length."""
    out: dict[int, dict[int, int]] = {PIECE: {}, GAP: {}}
    for r in rows.groupBy("kind", "v").agg(F.count("*").alias("n")).collect():
        out[r["kind"]][r["v"]] = r["n"]
    return out


@dataclass
class _Plan:
    """Open gaps, as tables with the counts of their sizes, and the seats given so far."""

    seq_len: int
    task_rows: int
    opened: int = 0
    gaps: list[DataFrame] = field(default_factory=list)
    sizes: dict[int, int] = field(default_factory=dict)
    seats: list[DataFrame] = field(default_factory=list)

    def take(self, least: int) -> list[DataFrame]:
        """The gaps of at least that size, which leave the plan."""
        out = [g.where(F.col("v") >= least) for g in self.gaps]
        self.gaps = [g.where(F.col("v") < least) for g in self.gaps]
        self.sizes = {v: n for v, n in self.sizes.items() if v < least}
        return out

    def open_for(self, spark, counts: dict[int, int]) -> None:
        """New sequences for pieces larger than any gap."""
        top = max(self.sizes, default=0)
        over = sorted(v for v in counts if v > top)
        new = _opened_for(np.asarray(over, dtype=np.int64), np.asarray([counts[v] for v in over], dtype=np.int64), self.seq_len)
        if new:
            self.gaps.append(spark.range(self.opened, self.opened + new).select(F.lit(GAP).alias("kind"), "id", F.lit(self.seq_len).alias("v"), F.lit(0).cast("bigint").alias("other")))
            self.sizes[self.seq_len] = self.sizes.get(self.seq_len, 0) + new
            self.opened += new

    def settle(self, after: DataFrame, seats: DataFrame) -> dict[int, int]:
        """Keeps gaps and seats; counts of the pieces that are left."""
        found = _histogram(after)
        self.seats.append(seats)
        self.gaps.append(after.where(F.col("kind") == GAP))
        for v, n in found[GAP].items():
            self.sizes[v] = self.sizes.get(v, 0) + n
        if len(self.gaps) > 8:
            self.gaps = [table(_union(self.gaps), "pack-gaps")]
        return found[PIECE]

    def in_one_task(self, rows: DataFrame, hi: int, last: int) -> None:
        """Runs all supersteps of ``rows`` in a task, whose range they fit."""
        done = table(rows.coalesce(1).mapInArrow(_finished(self.opened, self.seq_len, hi, last), ROWS).select("kind", "id", "v", "other"), "pack-class")
        self.settle(done.where(f"kind <> {SEAT}"), done.where(f"kind = {SEAT}"))
        most = done.agg(F.max(F.when(F.col("kind") == SEAT, F.col("other")).otherwise(F.col("id")))).first()[0]
        self.opened = max(self.opened, -1 if most is None else most + 1)

    def run(self, rows: DataFrame) -> None:
        """Seats all of ``rows(kind, id, v, other)``, pieces shorter than a sequence."""
        spark, counts, hi = rows.sparkSession, _histogram(rows)[PIECE], self.seq_len
        while counts:
            own = {v: n for v, n in counts.items() if v > hi // CLASS}
            counts = {v: n for v, n in counts.items() if v not in own}
            here = rows.where((F.col("v") > hi // CLASS) & (F.col("v") <= hi))
            every = sum(own.values()) + sum(counts.values())
            if every + sum(n for v, n in self.sizes.items() if v >= min([*own, *counts])) <= self.task_rows:
                self.in_one_task(_union([rows.where(F.col("v") <= hi), *self.take(min([*own, *counts]))]), hi, 0)
                return
            while own:
                least, n = min(own), sum(own.values())
                if n + sum(k for v, k in self.sizes.items() if v >= least) <= self.task_rows:
                    self.in_one_task(_union([here, *self.take(least)]), hi, hi // CLASS)
                    break
                self.open_for(spark, own)
                active = sum(k for v, k in self.sizes.items() if v >= least)
                each = -(-n // active)
                slots = sum(k * max(1, min(each, v // hi)) for v, k in self.sizes.items() if v >= least)
                spread = _union([here, *(_slots(g, hi, each) for g in self.take(least))])
                after, seats = _superstep(spread, min(MAX_RANGES, -(-(n + slots) // self.task_rows)))
                if slots > active:
                    whole = after.where(F.col("kind") == GAP).groupBy("kind", "id").agg(F.sum("v").cast("int").alias("v")).withColumn("other", F.lit(0).cast("bigint"))
                    after = table(whole.unionByName(after.where(F.col("kind") == PIECE)), "pack-merged")
                own = self.settle(after, seats)
                here = after.where(F.col("kind") == PIECE)
            hi //= CLASS


def seats_of(made: DataFrame, seq_len: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(pid, sequence_id)`` of pieces ``made(pid, length)`` shorter than a sequence."""
    plan = _Plan(seq_len, task_rows)
    plan.run(made.select(F.lit(PIECE).alias("kind"), F.col("pid").alias("id"), F.col("length").cast("int").alias("v"), F.lit(0).cast("bigint").alias("other")))
    if not plan.seats:
        return made.sparkSession.createDataFrame([], "pid bigint, sequence_id bigint")
    return _union([s.select(F.col("id").alias("pid"), F.col("other").alias("sequence_id")) for s in plan.seats])


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text", task_rows: int = TASK_ROWS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    A document is its ids followed by id 0; a null or empty text is the single id 0. Only
    documents of more than ``seq_len`` ids are cut, their first piece taking the remainder;
    a text is encoded whole however long it is. Repeated rows and ids are packed as
    separate documents; null ids stay null. Extra columns, whatever their names, are
    ignored. An empty table gives an empty table. Pieces of full length are sequences of
    their own, with negative numbers. Which sequence a piece gets depends on how the input
    is partitioned, as ties go by place; it doesn't depend on ``task_rows``.
    """
    made = table(pieces(docs, tokenizer, seq_len, id_col, text_col), "pieces")
    short = made.where(F.col("length") < seq_len)
    seated = short.join(seats_of(short, seq_len, task_rows), "pid")
    before = Window.partitionBy("sequence_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # at most seq_len rows
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    seated = seated.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint"))).select(*out)
    full = made.where(F.col("length") == seq_len).withColumn("sequence_id", -1 - F.col("pid")).withColumn("offset", F.lit(0).cast("bigint"))
    return seated.unionByName(full.select(*out))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_ids(path: str, text: str) -> bool:
    """Whether ``token_ids`` gives the ids that the tokenizers library gives."""
    want = _tokenizer(path).encode(text, add_special_tokens=False).ids
    return token_ids(path, text).tolist() == want
