"""Prefix trie of conversations: shared openings, their branches, and the words that sharing saves.

A turn travels as a 128-bit digest of role and text, a node as the digest of its path, so
distinct nodes are counted by an aggregation before any trie is built. Nodes are dealt by
the digest of their first turn; tries of pointers are built a bucket at a time inside
``applyInPandas`` and folded in postorder. A first-turn subtrie with too many nodes is
dealt anew by the next turn, and so on; its top is folded from the parts afterwards. A
conversation's turns that no other one shares are a chain that needs no trie.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.scratch import near, place, shielded, table

#: Conversations that open alike: those of a block may repeat up to HEADS - 1 turns of its first.
BLOCK, HEADS = 20, 4
#: Nodes of a subtrie, and on average of a bucket of them, that one group builds.
SUBTRIE_NODES = 4_096
#: Ids whose text is one row on the way to a node's hash: a shift of conv_id.
CHUNK_BITS = 12
ROOT = b"\0"

_WALK = "conv_id bigint, depth bigint, node binary, parent binary, first binary, words bigint, last boolean"
_TRIE = "node binary, parent binary, depth bigint, words bigint, n bigint, c bigint, tail bigint, above bigint"
_OUT = "node binary, parent binary, depth bigint, n bigint, c bigint, tail bigint, above bigint, children bigint, leaves bigint, saved bigint"


def prefix_trie(conversations: DataFrame, subtrie_nodes: int = SUBTRIE_NODES) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, nulls first, those that tie by the digest of role and
    text; repeated rows are repeated turns. Null role and text count as empty, an empty or
    very long text is digested whole. Rows without a conv_id belong to no conversation and
    are left out. Other columns are ignored, whatever their names; an empty table has no
    root and gives no rows. A conversation's turns pass one task as a stream. A chain of
    more than ``subtrie_nodes`` turns that several conversations share costs a round a turn
    beyond that number.
    """
    walk = table(_rebuilt(conversations), "walk")
    root = walk.where("last").agg(F.count("*").alias("n"), F.min("conv_id").alias("c")).first()
    nodes = walk.where("depth > 0").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("first").alias("first"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("c")
    )
    nodes = table(nodes, "nodes")
    lone = nodes.where("n = 1").groupBy("c").agg(F.min(F.struct("depth", "node", "parent", "first", "words")).alias("top"), F.max("depth").alias("last"))
    lone = lone.select("top.*", F.lit(1).cast("bigint").alias("n"), "c", (F.col("last") - F.col("top.depth")).alias("tail"))
    open_ = nodes.where("n > 1").withColumn("tail", F.lit(0).cast("bigint")).unionByName(lone)
    open_ = open_.withColumn("above", F.lit(root["c"]).cast("bigint")).withColumnRenamed("first", "key")
    rounds = _rounds(table(open_, "trie"), walk, subtrie_nodes)

    # tops of subtries that were split, from the deepest split up, then the root
    done, tops = [], None
    for solved, split, depth in reversed(rounds):
        if split is not None:
            done.append(table(_folded(split, tops), "split"))
        tops = solved.where(F.col("depth") == depth)
        if split is not None:
            tops = tops.unionByName(done[-1])
    own = walk.sparkSession.createDataFrame([(bytearray(ROOT), None, 0, 0, root["n"], root["c"], 0, None)], _TRIE).where("n > 0")
    body = _folded(own, tops)
    for part in [*(s for s, _, _ in rounds), *done]:
        body = body.unionByName(part)
    return _named(body, _ends(walk))


def _rebuilt(conversations: DataFrame) -> DataFrame:
    rows = shielded(conversations)
    conv, role, text = F.col(place(conversations, "conv_id")).cast("bigint"), *[F.coalesce(F.col(place(conversations, c)), F.lit("")) for c in ("role", "text")]
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where(conv.isNotNull()).select(
        (conv - conv % BLOCK).alias("block"), conv.alias("conv_id"), F.col(place(conversations, "turn")).alias("turn"), F.substring(digest, 1, 16).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words"),
    )
    dealt = turns.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "digest")
    return dealt.drop("turn").mapInArrow(_walk, _WALK)


def _walk(batches: Iterator) -> Iterator:
    """Ordered turns, a block's own conversation first, to a row per rebuilt turn; one of depth 0 for the turnless."""
    import pyarrow as pa

    names = [f.split()[0] for f in _WALK.split(", ")]
    out, now, block, heads = [], None, None, []

    def emit() -> pa.RecordBatch:
        cols = [list(c) for c in zip(*out, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    path = None  # of the conversation at hand: depth, node, first, and its row that isn't passed on yet

    def step(digest: bytes, words: int) -> None:
        depth, node, first, pending = path
        if pending:
            out.append((*pending, False))
        child = hashlib.blake2b(node + digest, digest_size=16).digest()
        first = first or child
        path[:] = depth + 1, child, first, (now, depth + 1, child, node, first, words)

    def finish() -> None:
        if path:
            out.append((*(path[3] or (now, 0, ROOT, None, None, 0)), True))

    for batch in batches:
        for b, c, digest, words in zip(*(batch.column(k).to_pylist() for k in ("block", "conv_id", "digest", "words")), strict=True):
            if c != now:
                finish()
                now, place_, path = c, 0, [0, ROOT, None, None]
                if b != block:
                    block, heads = b, []
                skip = 0 if c == b else zlib.crc32(str(c).encode()) % HEADS
                for head in heads[:skip]:
                    step(*head)
            if c == b and place_ < HEADS - 1:
                heads.append((digest, words))
            if place_ >= skip:
                step(digest, words)
            place_ += 1
        if len(out) >= 10_000:
            yield emit()
    finish()
    if out:
        yield emit()


def _rounds(open_: DataFrame, walk: DataFrame, limit: int) -> list[tuple[DataFrame, DataFrame | None, int]]:
    """Per depth of dealing: the solved rows, the tops of the subtries that were split (None if none was), the depth."""
    rounds, depth = [], 1
    while True:
        big = table(open_.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > limit).select("key"), "big")
        some = not big.isEmpty()
        closed = open_.join(near(big), "key", "left_anti") if some else open_
        buckets = max(1, math.ceil(closed.count() / limit))
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
        solved = table(closed.groupBy(bucket).applyInPandas(_build, _OUT), "solved")
        if not some:
            return [*rounds, (solved, None, depth)]
        rest = open_.join(near(big), "key", "left_semi")
        split = table(rest.where("node = key"), "split-tops")
        rounds.append((solved, split, depth))
        depth += 1
        nxt = walk.where(F.col("depth") == depth).select(F.col("conv_id").alias("c"), F.col("node").alias("next"))
        rest = rest.where("node <> key").drop("above").join(near(split.select("key", F.col("c").alias("above"))), "key")
        open_ = table(rest.join(nxt, "c").drop("key").withColumnRenamed("next", "key"), "trie")


def _build(rows):
    """A bucket of subtries: pointers from a node to its children, folded in postorder without recursion."""
    import pandas as pd

    ids, parents, keys, words, n, c, tail, above = (rows[k].tolist() for k in ("node", "parent", "key", "words", "n", "c", "tail", "above"))
    below: dict[bytes, list[int]] = {}
    for k, p in enumerate(parents):
        below.setdefault(p, []).append(k)
    children, leaves, saved = [0] * len(ids), [0] * len(ids), [0] * len(ids)
    for top in (k for k in range(len(ids)) if ids[k] == keys[k]):
        stack = [(top, False)]
        while stack:
            k, ready = stack.pop()
            if n[k] == 1:  # the head of a chain
                children[k], leaves[k] = int(tail[k] > 0), 1
                continue
            own = below.get(ids[k], ())
            if not ready:
                stack.append((k, True))
                stack.extend((x, False) for x in own)
                continue
            for x in own:
                above[x] = c[k]
            children[k], leaves[k] = len(own), sum(leaves[x] for x in own) or 1
            saved[k] = (n[k] - 1) * words[k] + sum(saved[x] for x in own)
    return pd.DataFrame({"node": ids, "parent": parents, "depth": rows["depth"], "n": n, "c": c, "tail": tail, "above": above, "children": children, "leaves": leaves, "saved": saved})


def _folded(split: DataFrame, tops: DataFrame) -> DataFrame:
    """Split tops, or the root, with sums over the subtries below."""
    sums = tops.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    out = split.join(sums, "node", "left")
    saved = F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("words")
    return out.select("node", "parent", "depth", "n", "c", "tail", "above", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), saved.alias("saved"))


def _ends(walk: DataFrame) -> DataFrame:
    """``(node, ends)``: the hash of the ascending ids of conversations that end there, streamed from chunks of ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = walk.where("last").groupBy("node", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(_hash, "node binary, ends string")


def _hash(batches: Iterator) -> Iterator:
    import pyarrow as pa

    now, state, nodes, ends = None, None, [], []
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == now:
                state.update(b",")
            else:
                if now is not None:
                    nodes.append(now)
                    ends.append(state.hexdigest())
                now, state = node, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(ends, pa.string())], names=["node", "ends"])
        nodes, ends = [], []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])


def _named(body: DataFrame, ends: DataFrame) -> DataFrame:
    none, alone = F.lit(hashlib.sha256(b"").hexdigest()), F.sha2(F.col("c").cast("string").cast("binary"), 256)
    cols = lambda end: [F.col("c").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), end.alias("ends_sha256")]
    shared = body.where("n > 1 OR depth = 0").join(ends, "node", "left").select(*cols(F.coalesce("ends", none)))
    heads = body.where("n = 1 AND depth > 0")
    at_end = F.when(F.col("tail") == 0, alone).otherwise(none)
    chain = heads.where("tail > 0").withColumn("last", F.col("depth") + F.col("tail")).withColumn("depth", F.explode(F.sequence(F.col("depth") + 1, "last")))
    chain = chain.withColumn("tail", F.col("last") - F.col("depth")).withColumn("children", (F.col("tail") > 0).cast("bigint")).withColumn("above", F.col("c"))
    return shared.unionByName(heads.select(*cols(at_end))).unionByName(chain.select(*cols(at_end)))
