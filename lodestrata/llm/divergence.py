"""Divergence audit of sources: how far the smoothed term frequencies of a language's sources lie apart.

A scan counts terms per (lang, source); terms that too few documents of a language hold
are dropped. For each pair of sources the *joint histogram* of their counts is tallied:
how many kept terms one source holds ``a`` times and the other ``b`` times, cells with
zeros included. The difference is then evaluated once per (a, b) and multiplied.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import near, place, shielded, table

#: A term, on the UTF-8 bytes: letters A-Z, a-z and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Entries that a task's counts hold before they are passed on.
HELD = 200_000
#: Cells of a dense block of terms and sources, and bytes above which a text's words aren't listed at once.
CELLS, LONG = 1 << 21, 1 << 20
SCALE, SMOOTH = 1_000_000_000, 5


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources and each source's ``top`` overused terms.

    Null text, lang and source count as ''. Whole texts are read, however long; a repeated
    row is one more document, doc_id isn't read. A source without terms, and a language
    without kept terms, still has its pairs (value 0 in the latter). A language of one
    source has no pairs. Other columns are ignored, whatever their names; an empty table
    gives an empty one. The result lists all pairs of a language's sources, so it grows
    with their square; what is broadcast is counted first.
    """
    rows = shielded(docs).select(*[F.coalesce(F.col(place(docs, c)), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = rows.select("lang", "source").distinct()
    by_name = Window.partitionBy("lang")
    names = table(names.withColumn("idx", F.row_number().over(by_name.orderBy("source")) - 1).withColumn("sources", F.count("*").over(by_name).cast("int")), "sources")

    counted = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    # one shuffle: the finer grouping is served by the coarser partitioning
    cells = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = cells.join(near(names), ["lang", "source"])
    kept = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("idx", "n")).alias("cells"), F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"), F.first("sources").alias("sources"))
    kept = table(kept.where(F.col("docs") >= least_docs).drop("docs"), "terms")

    words = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.idx").alias("idx")).agg(F.sum("c.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    groups = names.join(words, ["lang", "idx"], "left").join(sizes, "lang", "left")
    groups = table(groups.select("lang", "source", "idx", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "groups")
    return _pairs(kept, groups).unionByName(_terms(kept, groups, top))


def _share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + 5) / (total + 5 v)), exact."""
    over = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total + v * SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", over, under) + 1


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    tally = kept.select("lang", "sources", "cells").mapInArrow(_tally, "lang string, i int, j int, a bigint, b bigint, m bigint")
    cells = tally.groupBy("lang", "i", "j", "a", "b").agg(F.sum("m").alias("m"))
    one = near(groups.select("lang", F.col("idx").alias("i"), F.col("total").alias("total_i"), "v"))
    two = near(groups.select("lang", F.col("idx").alias("j"), F.col("total").alias("total_j")))
    f = F.abs(_share(F.col("a"), F.col("total_i"), F.col("v")) - _share(F.col("b"), F.col("total_j"), F.col("v")))
    apart = cells.join(one, ["lang", "i"]).join(two, ["lang", "j"]).groupBy("lang", "i", "j").agg(F.sum(f * F.col("m")).alias("value"))
    apart = table(apart, "apart")
    apart = apart.unionByName(apart.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    left = groups.select("lang", "source", F.col("idx").alias("i"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("j"))
    pairs = left.join(right, "lang").where("i <> j").join(apart, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(_order()))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = kept.select("lang", "term", "in_lang", F.explode("cells").alias("c")).select("lang", "term", "in_lang", "c.idx", "c.n")
    cells = cells.join(near(groups), ["lang", "idx"])
    value = _share(F.col("n"), F.col("total"), F.col("v")) - _share(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    over = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0")
    return over.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= top)


def _order() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _count(batches: Iterator) -> Iterator:
    """``(lang, source, text)`` to partial counts of terms and of documents that hold them."""
    import pyarrow as pa

    held, size = {}, 0

    def out() -> Iterator:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            raw = text.encode().lower()  # of bytes: only A-Z
            words = TERM.findall(raw) if len(raw) < LONG else Counter(m.group() for m in TERM.finditer(raw))
            if not words:
                continue
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def _tally(batches: Iterator) -> Iterator:
    """``(lang, sources, cells)`` to how many terms have each pair of counts, for each pair of sources."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("sources").to_numpy(zero_copy_only=False)
        cells = batch.column("cells")
        ends = cells.offsets.to_numpy()
        idx, n = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lang in dict.fromkeys(langs):
            own = [k for k, x in enumerate(langs) if x == lang]
            wide = int(sources[own[0]])
            for lo in range(0, len(own), step := max(1, CELLS // wide)):
                part = own[lo : lo + step]
                dense = np.zeros((wide, len(part)), np.int64)
                for k, row in enumerate(part):
                    s = slice(ends[row], ends[row + 1])
                    dense[idx[s], k] = n[s]
                # counts as ranks among those that occur here, so that a pair of them is one number
                values, ranks = np.unique(dense, return_inverse=True)
                ranks = ranks.reshape(dense.shape).astype(np.int64)
                for i in range(wide):
                    out = []
                    for j in range(i + 1, wide):
                        codes, m = np.unique(ranks[i] * len(values) + ranks[j], return_counts=True)
                        out.append((np.full(len(m), j, np.int32), values[codes // len(values)], values[codes % len(values)], m))
                    if out:
                        j, a, b, m = (np.concatenate(c) for c in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(m), pa.string()), pa.array(np.full(len(m), i, np.int32)), pa.array(j), pa.array(a), pa.array(b), pa.array(m.astype(np.int64))], names=["lang", "i", "j", "a", "b", "m"])
