"""The divergence audit against plain counting."""

import re
from collections import Counter

from pyspark.sql import functions as F

from lodestrata.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        both = sum(counts.values(), Counter())

        def share(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)

        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, t) - share(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, share(c, t) - share(both, t)) for t in kept if c[t] and share(c, t) > share(both, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def rows():
    made = [(k, f"The {'alpha ' * (k % 4)}beta{'x' * (k % 2)} ÉTÉ été {'zeta' if k % 3 else 'eta'}-one_two3four", ("en", "de")[k % 2], f"s{k % 5}") for k in range(60)]
    made += [(None, "Alpha beta", None, None), (7, None, "en", "empty"), (7, "", "fr", "a"), (8, "rare words only", "fr", "b"), (9, "12 34", "xx", None), (9, "12 34", "xx", None)]
    made += [(100, "alpha " * 400_000 + "Beta " * 3, "en", "long")] + [(200 + k, "hot hot beta", "en", "hot") for k in range(40)]
    return made


def same(df, want):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in df.collect()) == want


def test_matches_plain_counting(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    same(divergence.divergence(df, least_docs=3, top=4), plain(rows(), 3, 4))
    same(divergence.divergence(df), plain(rows(), 30, 50))


def test_small_flushes_and_blocks(spark, monkeypatch):
    # workers are forked with these values in the closure's module only if it is shipped, so the functions are called here
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    data = [r for r in rows() if r[0] != 100]
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in data], "source": [r[3] or "" for r in data], "text": [r[1] or "" for r in data]})
    total = Counter()
    for b in divergence._count(iter([batch])):
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[lang, source, term] += n
    want = Counter((r[2] or "", r[3] or "", t) for r in data for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")))
    assert total == want
    monkeypatch.setattr(divergence, "CELLS", 4)
    kinds = pa.schema([("lang", pa.string()), ("sources", pa.int32()), ("cells", pa.list_(pa.struct([("idx", pa.int32()), ("n", pa.int64())])))])
    cells = [[{"idx": 0, "n": 2}], [{"idx": 1, "n": 1}, {"idx": 0, "n": 2}], [{"idx": 2, "n": 9}]]
    tally = Counter()
    for b in divergence._tally(iter([pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "sources": [3] * 3, "cells": cells}, schema=kinds)])):
        for _, i, j, a, c, m in zip(*(x.to_pylist() for x in b.columns), strict=True):
            tally[i, j, a, c] += m
    assert tally == {(0, 1, 2, 0): 1, (0, 1, 2, 1): 1, (0, 1, 0, 0): 1, (0, 2, 2, 0): 2, (0, 2, 0, 9): 1, (1, 2, 0, 0): 1, (1, 2, 1, 0): 1, (1, 2, 0, 9): 1}


def test_empty_and_clashing_columns(spark, empty):
    assert divergence.divergence(empty).count() == 0
    df = spark.createDataFrame(rows(), SCHEMA).select(F.lit(1).alias("idx"), F.col("text").alias("TEXT"), F.lit(1).alias("term"), F.lit(4).alias("n"), "Lang", "source", F.lit(2).alias("sources"))
    same(divergence.divergence(df, least_docs=3, top=4), plain(rows(), 3, 4))
