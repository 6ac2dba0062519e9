"""Greedy choices in a given order, decided in parallel rounds with the serial order's result.

An item becomes a leader if no earlier leader of its group is similar to it, else it joins
the first such leader. Whether an item leads depends on earlier similar items only, so in a
round every item without an undecided earlier one is decided at once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stored

#: Undecided items of a posting that a round compares with each other.
HEAD = 64


def first_leaders(items: DataFrame, threshold: float, head: int = HEAD, postings: DataFrame | None = None) -> DataFrame:
    """``items(group, place, words)`` with distinct words and unique places to ``(place, leader)``, the first similar leader's place.

    Sets are similar if they share at least ``threshold`` of their union; an empty one is
    similar to none and leads itself. Items meet in posting lists of what two similar sets
    have in common (``signatures``). Of a list a round compares its first ``head`` undecided items
    with each other and its new leaders with the rest: a group of near copies costs one
    comparison each, and no task holds a group. ``postings(key, place)`` are those of the
    items, if they are known.
    """
    if postings is None:
        postings = shared(signatures(items, threshold, "place"), "place")
    need = F.count("*").over(Window.partitionBy("place"))
    postings = stored(postings.select("key", "place").withColumn("need", need), "postings")
    listed = postings.select("place").distinct()
    wide = stored(items.join(listed, "place", "left_semi").select("group", "place", "words", F.size("words").alias("n")), "sets")
    open_ = postings
    leaders, links = [], []
    while not open_.isEmpty():
        rank = F.row_number().over(Window.partitionBy("key").orderBy("place"))
        heads = stored(open_.withColumn("rank", rank).where(F.col("rank") <= head).drop("rank"), "heads")
        free = heads.groupBy("place").agg((F.count("*") == F.first("need")).alias("free")).where("free").select("place")
        pairs = _met(heads, heads.join(free, "place", "left_semi"))
        blocked = _similar(pairs, wide, threshold).select(F.col("b").alias("place"))
        new = stored(free.join(blocked, "place", "left_anti"), "leaders")
        found = stored(_similar(_met(postings.join(new, "place", "left_semi"), postings), wide, threshold), "links")
        leaders.append(new)
        links.append(found)
        decided = new.unionByName(found.select(F.col("b").alias("place")))
        open_ = stored(open_.join(decided.distinct(), "place", "left_anti"), "open")
    out = items.select("place").join(listed, "place", "left_anti").select("place", F.col("place").alias("leader"))
    if links:
        led = functools.reduce(DataFrame.unionByName, leaders)
        out = out.unionByName(led.select("place", F.col("place").alias("leader")))
        joined = functools.reduce(DataFrame.unionByName, links).groupBy(F.col("b").alias("place")).agg(F.min("a").alias("leader"))
        out = out.unionByName(joined)
    return out


def signatures(sets: DataFrame, threshold: float, ident: str) -> DataFrame:
    """``(key, ident)`` of the non-empty ``sets(group, words, ident)``; two similar sets of a group have a key in common.

    Sizes form classes, so that similar sets are of one or of two neighbouring ones. A set
    is cut by its words' hashes into one part more than two similar sets of its class, or of
    the next, may differ in words; then one part at least is the same in both. A key is
    such a part's hash: of some ten words at a threshold of 0.9, so hardly any but similar
    sets meet, however common their words.
    """
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    kind = sets.schema[ident].dataType.simpleString()
    rows = sets.where(F.size("words") > 0).select(F.xxhash64("group").alias("g"), F.col(ident), hashes.alias("hs"))
    return rows.mapInArrow(lambda b: _parts(b, threshold), f"key bigint, {ident} {kind}")


def shared(keys: DataFrame, ident: str) -> DataFrame:
    """The rows of ``keys(key, ident)``, once each, whose key others have too."""
    own = keys.repartition("key").dropDuplicates(["key", ident])
    return own.withColumn("times", F.count("*").over(Window.partitionBy("key"))).where("times > 1").drop("times")


def _classes(sizes, threshold: float):
    """Least sizes of the classes up to the largest of ``sizes`` and one beyond, and the parts of each class."""
    import numpy as np

    least = [1]
    while len(least) < 3 or least[-2] <= max(sizes):
        least.append(max(least[-1] + 1, math.floor((least[-1] - 1) / threshold + 1e-9) + 1))
    differ = 2 * (np.array(least[1:]) - 1) * (1 - threshold) / (1 + threshold)
    return np.array(least[:-1]), np.floor(differ + 1e-6).astype(np.int64) + 1


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _parts(batches: Iterator, threshold: float) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(2)
        ends, h = lists.offsets.to_numpy().astype(np.int64), _mixed(lists.values.to_numpy().view(np.uint64))
        ends, h = ends - ends[0], h[ends[0] : ends[-1]]
        sizes = np.diff(ends)
        least, parts = _classes(sizes, threshold)
        own = np.searchsorted(least, sizes, "right") - 1
        group = b.column(0).to_numpy().view(np.uint64)
        for step in (0, 1):  # as a member of its class, and as the smaller one of a pair with the next
            of = own + step
            starts = np.concatenate([[0], np.cumsum(parts[of])])
            at = np.repeat(starts[:-1], sizes) + (h % np.repeat(parts[of], sizes).astype(np.uint64)).astype(np.int64)
            sums = np.zeros(starts[-1], np.uint64)
            np.add.at(sums, at, _mixed(h))
            row = np.repeat(np.arange(len(sizes)), parts[of])
            place = np.arange(starts[-1]) - starts[row]
            key = _mixed(_mixed(sums + group[row]) + (of[row].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1).take(pa.array(row))], names=["key", b.schema.names[1]])


def _met(early: DataFrame, late: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of an earlier and a later place that share a posting."""
    a = early.select("key", F.col("place").alias("a"))
    b = late.select("key", F.col("place").alias("b"))
    return a.join(b, "key").where("a < b").select("a", "b").distinct()


def _similar(pairs: DataFrame, wide: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets are of one group and similar; what can't be by its size is left out before words are sent."""
    slim = wide.select("place", "group", "n")
    both = pairs.join(slim.toDF("a", "ga", "nx"), "a").join(slim.toDF("b", "gb", "ny"), "b").where("ga = gb").drop("ga", "gb")
    both = both.where(F.least("nx", "ny") >= F.greatest("nx", "ny") * F.lit(threshold) - 1e-9)
    both = both.join(wide.select(F.col("place").alias("a"), F.col("words").alias("x")), "a").join(wide.select(F.col("place").alias("b"), F.col("words").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= (F.col("nx") + F.col("ny") - common) * F.lit(threshold)).select("a", "b")
