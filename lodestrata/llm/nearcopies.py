"""Near copies by SimHash search and exact Jaccard similarity of distinct word shingles.

The SimHash operator's vantage-point trees find the fingerprints within a few bits of each
other; those pairs are decided by their shingles. Pairs at a similarity of 4/5 differ in
about ten bits of 64, a radius at which the trees prune nothing, so the rest is found
exactly by prefix filtering: texts with that similarity share a shingle among the first
``n - ceil(4n/5) + 1`` of their ``n`` distinct shingles under any order common to all. The
order puts shingles that a sample of documents repeats last; it changes the work, not the
result. Both see only texts that share enough shingles with others (``shares``), a seventh
or so of a corpus with few near copies.

Texts that meet at a shingle are first compared with their neighbours there, by size and
in random orders, in two rounds, which joins groups of copies whatever their size. After that only pairs
from different components are formed: at a shingle the texts outside its commonest
component against the others, and only where a pair hasn't met at the shingles just before.

Shingles and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import shares, simhash
from lodestrata.llm.components import components
from lodestrata.llm.scratch import near, place, sampled, shielded, table, unshielded

SAMPLE = 20_000
#: Shingles before the shared one by which a pair that met already is told.
BEFORE = 3
#: Candidates of a text that the first neighbour round compares.
CLOSEST = 2
#: Partners of a text that one task compares with it, about.
PARTNERS = 64
#: Pairs of numbers that are broadcast at most, some 16 MB.
NAMED = 1_000_000
#: Keys of rows that go which are broadcast at most, some 16 MB.
GONE = 300_000
COMMON = 3
MAX_COMMON = 1 << 18
WORDS_KEPT = 1 << 18
#: Shingles of texts that a task keeps while it compares pairs.
SETS_KEPT = 1 << 21
SEED = 42


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingles(text: str | bytes | None, words: int, hashes: dict | None = None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a text without words has none."""
    hashes = _Hashes() if hashes is None else hashes
    raw = text.encode() if isinstance(text, str) else text or b""
    parts = raw.lower().split()
    h = np.fromiter((hashes[p] for p in parts), dtype=np.uint64, count=len(parts))
    if not h.size:
        return h
    width = min(words, h.size)
    out = np.full(h.size - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + out.size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which near copies share one, rare ones first; ``common`` is sorted."""
    if common.size:
        at = np.minimum(np.searchsorted(common, h), common.size - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
    return h[: h.size - -(-4 * h.size // 5) + 1]


def _nodes(docs: DataFrame, id_col: str, text_col: str, *row) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), *[r.alias("row") for r in row], F.xxhash64(text).alias("node"), text.alias("t"))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [shingles(t, words, hashes) for t in part.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *[s.size for s in sets]]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "hs"])

    return run


def _sets_of(nodes: DataFrame, words: int) -> DataFrame:
    return nodes.select("node", "t").mapInArrow(_sets(words), "node bigint, hs array<bigint>")


def _common(nodes: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those that at least COMMON documents of a sample hold, the commonest MAX_COMMON at most."""
    some = sampled(nodes, F.col("node"), nodes.count(), SAMPLE)
    counted = _sets_of(some, words).select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    got = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MAX_COMMON).toArrow()
    h = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got.column("n").to_numpy()[order]


def _prefixes(words: int, common: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                nodes, ns, hs = [], [], []
                for node, t in zip(b.column(0).slice(k, 256).to_pylist(), b.column(1).slice(k, 256).cast(pa.binary()).to_pylist(), strict=True):
                    h = shingles(t, words, hashes)
                    if h.size:
                        nodes.append(node)
                        ns.append(h.size)
                        hs.append(prefix(h, common, counts))
                if not nodes:
                    continue
                sizes = [p.size for p in hs]
                at = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(hs).view(np.int64)),
                        pa.array(np.repeat(np.array(nodes, dtype=np.int64), sizes)),
                        pa.array(np.repeat(np.array(ns, dtype=np.int32), sizes)),
                        pa.array(at),
                    ],
                    names=["h", "node", "n", "at"],
                )

    return run


def _may_match(a: str, b: str) -> str:
    """Whether the sizes, and the shingles that follow the one shared, leave room for a similarity of 4/5."""
    rest = f"least({a}.n - {a}.at, {b}.n - {b}.at)"
    return f"{a}.node <> {b}.node AND 5L * least({a}.n, {b}.n) >= 4L * greatest({a}.n, {b}.n) AND 9L * {rest} >= 4L * ({a}.n + {b}.n)"


def _agree(words: int):
    """Of rows ``a, node, t`` sorted by a, its own text first, the pairs that are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, kept = _Hashes(), {}, 0
        now = own = None
        for b in batches:
            found: list[tuple[int, int]] = []
            for a, node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                if (hs := sets.get(node)) is None:
                    hs = shingles(t.as_py(), words, hashes)
                    if kept > SETS_KEPT:
                        sets, kept = {}, 0
                    sets[node] = hs
                    kept += hs.size
                if a == node:
                    now, own = a, hs
                elif a == now and 9 * np.intersect1d(own, hs, assume_unique=True).size >= 4 * (own.size + hs.size):
                    found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def _verified(nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose similarity is 4/5 or more; ``nodes`` has a row a text.

    A text's partners are sent to it, once a pair, and shingled there: compressed texts are
    smaller than sets of hashes. A text with many partners meets them in several tasks.
    """
    dealt = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("k")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")))
    ends = dealt.select("a", "salt", F.col("a").alias("node")).distinct().unionByName(dealt.select("a", "salt", F.col("b").alias("node")))
    sent = nodes.join(near(table(ends, "near-ends"), NAMED), "node").select("a", "salt", "node", "t")
    sent = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("node") != F.col("a"))
    return sent.select("a", "node", "t").mapInArrow(_agree(words), "a bigint, b bigint")


def _searched(nodes: DataFrame, words: int, radius: int) -> DataFrame:
    """Pairs of texts whose fingerprints the trees link, each text of a fingerprint through its least one."""
    marked = table(simhash.fingerprints(nodes, "node", "t", words), "near-fingerprints")
    first = table(marked.groupBy("fp").agg(F.min("id").alias("first")), "near-first")
    same = marked.join(first, "fp").where("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y"))
    near_ = simhash.linked(first.select("fp"), radius)
    ends = near_.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    return same.unionByName(ends).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _neighbours(shared: DataFrame) -> DataFrame:
    """Each text's candidates among those next to it, the ones that it meets most often."""
    met = shared.select("node", "n", "at", F.explode(F.array("by_size", "by_chance")).alias("o")).where("o.node IS NOT NULL").alias("x")
    met = met.where(_may_match("x", "x.o")).groupBy("node", F.col("o.node").alias("other")).agg(F.count("*").alias("times"))
    best = Window.partitionBy("node").orderBy(F.desc("times"), "other")
    met = met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= CLOSEST)
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of shingles at which several components meet.

    ``main`` is the commonest component there and ``top`` its most central text: the one
    whose shingles most texts share, so that the least changed copies come first.
    """
    own = Window.partitionBy("node")
    held = shared.select("h", "node", "n", "at", "times").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = held.withColumn("before", F.array_compact(F.array(*[F.lag("h", k).over(own.orderBy("at")) for k in range(1, BEFORE + 1)])))
    held = table(held.withColumn("central", F.sum("times").over(own) / F.col("n")).drop("times"), "near-held")
    text = F.struct("central", "node", "n", "at")
    counts = held.groupBy("h", "label").agg(F.count("*").alias("times"), F.max(text).alias("top"))
    main = counts.groupBy("h").agg(F.max_by(F.struct(F.col("label").alias("main"), "top"), F.struct("times", "label")).alias("m"), F.count("*").alias("labels"))
    return table(held.drop("central").join(main.where("labels > 1").select("h", "m.main", "m.top"), "h"), "near-open")


def _tops(open_: DataFrame) -> DataFrame:
    """Texts outside the commonest component of a shingle, and that component's most central text."""
    x = open_.where("label <> main").alias("x").where(_may_match("x", "x.top"))
    return x.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()


def _merged(open_: DataFrame, links: DataFrame) -> DataFrame:
    """``open_`` with the components that ``links`` between texts join."""
    of = open_.select("node", "label").distinct()
    ends = links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = near(table(components(ends), "near-joined"))
    out = open_.join(joined.toDF("label", "to"), "label", "left").join(joined.toDF("main", "main_to"), "main", "left")
    return out.withColumn("label", F.coalesce("to", "label")).withColumn("main", F.coalesce("main_to", "main")).drop("to", "main_to", "top")


def _across(open_: DataFrame) -> DataFrame:
    """Every pair of texts of different components that meets at a shingle and may be near."""
    x, y = open_.where("label <> main").alias("x"), open_.alias("y")
    once = "(y.label = y.main OR x.node < y.node) AND NOT arrays_overlap(x.before, y.before)"
    pairs = x.join(y, F.expr(f"x.h = y.h AND x.label <> y.label AND {_may_match('x', 'y')} AND {once}"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _paired(nodes: DataFrame, words: int) -> DataFrame:
    """Texts that may have near copies, and no others but some that share as many shingles with several texts; repeats stay."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        hashes = _Hashes()
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                yield node, shingles(t.as_py(), words, hashes)

    lone = table(shares.lone(nodes, sets), "near-lone")
    some = table(nodes.select("node").distinct().join(lone, "node", "left_anti"), "near-some")
    return table(nodes.select("node", "t").join(near(some, NAMED), "node", "left_semi"), "near-paired")


def _labels(nodes: DataFrame, words: int, radius: int) -> DataFrame:
    """``(node, label)`` of the texts that have near copies."""
    nodes = _paired(nodes, words)
    if not nodes.groupBy("node").count().where("count > 1").isEmpty():
        nodes = table(nodes.select("node", "t").dropDuplicates(["node"]), "near-texts")
    first = table(_verified(nodes, table(_searched(nodes, words, radius), "near-searched"), words), "near-links")

    common, counts = _common(nodes, words)
    rows = nodes.select("node", "t").mapInArrow(_prefixes(words, common, counts), "h bigint, node bigint, n int, at int")
    text, meets = F.struct("node", "n", "at"), Window.partitionBy("h")
    by_size = meets.orderBy("n", "node")
    rows = rows.withColumn("by_size", F.lead(text).over(by_size)).withColumn("last", F.lag("node").over(by_size).isNull())
    rows = rows.where("by_size IS NOT NULL OR NOT last").drop("last")
    by_chance = meets.orderBy(F.xxhash64("node", "h"), "node")
    rows = rows.withColumn("by_chance", F.lead(text).over(by_chance)).withColumn("times", F.count("*").over(meets))
    shared = table(rows, "near-shared")

    apart = _apart(_neighbours(shared), components(first))
    second = table(_verified(nodes, apart, words), "near-links")
    open_ = _open(shared, components(_union([first, second])))
    tops = table(_tops(open_).join(apart, ["a", "b"], "left_anti"), "near-tops")
    third = table(_verified(nodes, tops, words), "near-links")
    rest = _across(_merged(open_, third)).join(_union([apart, tops]), ["a", "b"], "left_anti")
    fourth = _verified(nodes, table(rest, "near-pairs"), words)
    return table(components(_union([first, second, third, fourth])), "near-labels")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    pairs, x, y = table(pairs, "near-pairs"), labels.toDF("a", "la"), labels.toDF("b", "lb")
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return table(both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), "near-apart")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """``id, component_id`` per input row; component_id is the least id reachable over near copies.

    Near copies have a Jaccard similarity of 4/5 or more between their sets of ``words``-word
    shingles. A null text counts as empty, and texts without words are copies of each other.
    Null ids never name a component unless all its ids are null. Whole texts are read,
    however long; repeated rows are kept; other columns of the input aren't read. An empty
    table gives an empty table. ``radius`` is that of the fingerprint search and doesn't
    change the result.
    """
    marked = _marked(_nodes(docs, id_col, text_col), words, radius)
    names = marked.groupBy("label").agg(F.min("id").alias("component_id"))
    return marked.join(names, marked["label"].eqNullSafe(names["label"])).select("id", "component_id")


def _marked(nodes: DataFrame, words: int, radius: int) -> DataFrame:
    """The rows with their component's label, null for texts without words."""
    labels = _labels(nodes, words, radius)
    wordless = ~F.col("t").rlike(r"[^ \t-\r]")
    marked = nodes.withColumn("text_node", F.col("node")).withColumn("node", F.when(~wordless, F.col("node"))).drop("t")
    marked = marked.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return table(marked.drop("node"), "near-marked")


def _without(marked: DataFrame, once: DataFrame) -> DataFrame:
    """The keys of ``marked`` that aren't in ``once``."""
    same = marked["id"].eqNullSafe(once["id"]) & (marked["text_node"] == once["text_node"]) & (marked["row"] == once["row"])
    return marked.join(once, same, "left_anti").select("id", "text_node", "row")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies.

    It is the row with the least id, null ids last; among rows that share that id the one
    with the least hash of text, then of the whole row; of rows that are equal in every
    column one. The decision is a row's: another text with an id that stays elsewhere
    goes. All columns are returned, whatever their names. For the rest see
    ``near_components``.
    """
    rows = shielded(docs)
    whole = F.xxhash64(*[F.col(c) for c in rows.columns])
    own = rows.withColumn("row", whole).withColumn("node", F.xxhash64(F.coalesce(F.col(place(docs, text_col)), F.lit(""))))
    nodes = _nodes(rows, place(docs, id_col), place(docs, text_col), whole)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_node", "row")
    marked = table(_marked(nodes, words, radius).groupBy("label", rank.alias("rank")).agg(F.count("*").alias("times")), "near-ranked")
    first = marked.groupBy("label").agg(F.min_by(F.struct("rank.*", "times"), "rank").alias("f")).select("f.id", F.col("f.text_node").alias("node"), "f.row", "f.times")
    # few rows go, so their keys are what is sent, not the texts of those that stay
    keys = [own[place(docs, id_col)].cast("bigint"), own["node"], own["row"]]
    first = table(first, "near-stays")
    once = first.where("times = 1").select("id", F.col("node").alias("text_node"), "row")
    gone = near(table(_without(marked.select("rank.*"), once), "near-gone"), GONE)
    alone = own.join(gone, keys[0].eqNullSafe(gone["id"]) & (keys[1] == gone["text_node"]) & (keys[2] == gone["row"]), "left_anti").select(*rows.columns)
    if not first.where("times > 1").isEmpty():
        many = first.where("times > 1")
        stay = own.join(many, keys[0].eqNullSafe(many["id"]) & (keys[1] == many["node"]) & (keys[2] == many["row"]), "left_semi")
        alone = alone.unionByName(stay.dropDuplicates(["node", "row"]).select(*rows.columns))
    return unshielded(alone, docs.columns)
