"""Packing and mixing: exact ids, gapless sequences, quotas and targets."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, corpus, prose
from lodestrata.llm import mixing, packing

PATH = packing.tokenizer_path()


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "don't 's x's", "a \n b\t c\r\n", "x\x1c y\x85 z", "　wide　space ", "<|endoftext|> a", "é€😀 ünï", "12 34.5 a1", prose(3, 400), "tail "])
def test_ids_are_the_tokenizers(text):
    assert packing.check_ids(PATH, text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_ids_of_the_corpus(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert packing.check_ids(PATH, r["text"])


def plain_sweep(rows):
    """Best-fit matching with a stack: (value, is gap, id) to pairs of ids."""
    stack, out = [], []
    for _, gap, i in sorted(rows):
        if not gap:
            stack.append(i)
        elif stack:
            out.append((stack.pop(), i))
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_brackets_and_ranks_are_one_sweep(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 300))
    v, gap = np.sort(r.integers(1, 40, n)), r.random(n) < 0.5
    order = np.lexsort((np.arange(n), gap, v))
    v, gap = v[order], gap[order]
    want = plain_sweep([(int(v[k]), bool(gap[k]), k) for k in range(n)])
    p, g = packing.brackets(gap)
    assert sorted(zip(p.tolist(), g.tolist(), strict=True)) == want
    cuts = np.sort(r.integers(0, n + 1, 5))
    pairs, counts, open_ = [], [], {}
    for part, at in enumerate(np.split(np.arange(n), cuts)):
        p, g = packing.brackets(gap[at])
        pairs += zip(at[p].tolist(), at[g].tolist(), strict=True)
        rest = np.setdiff1d(at, np.concatenate([at[p], at[g]]))
        open_[part] = rest[gap[rest]], rest[~gap[rest]]
        counts.append((part, len(open_[part][0]), len(open_[part][1])))
    for gap_part, first, part, last, k, _ in packing.across(counts).tolist():
        pairs += [(int(open_[part][1][last - j]), int(open_[gap_part][0][first + j])) for j in range(k)]
    assert sorted(pairs) == want


def best_fit_decreasing(sizes, n):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else n) - s)
    return len(gaps)


def made_of(spark, sizes):
    return spark.createDataFrame([(k, int(s)) for k, s in enumerate(sizes)], "pid bigint, length bigint").repartition(3)


@pytest.mark.parametrize("low,high,many", [(1, 2047, 800), (3, 60, 1500), (300, 900, 700), (700, 700, 300), (5, 5, 900), (1, 500, 40)])
def test_sequences_are_as_few_as_best_fit_decreasing_needs(low, high, many):
    sizes = np.random.default_rng(low).integers(low, high + 1, many)
    _, took, seq, *_ = packing.finish(np.arange(many), sizes, np.empty(0, np.int64), np.empty(0, np.int64), 0, 2048, 2048)
    assert sorted(took) == sorted(sizes) and np.bincount(seq, took).max() <= 2048
    assert np.unique(seq).size <= 1.01 * best_fit_decreasing(sizes.tolist(), 2048) + 1


def test_seats_do_not_depend_on_the_ranges(spark):
    r = np.random.default_rng(5)
    sizes = np.concatenate([r.integers(1, 2048, 60), np.full(90, 700), r.integers(1, 30, 150)])
    made, got = made_of(spark, sizes), []
    for rows in (10_000, 120, 37):
        seats = packing.seats_of(made, 2048, task_rows=rows).collect()
        assert sorted(x["pid"] for x in seats) == list(range(sizes.size))
        got.append(sorted(map(tuple, seats)))
    assert got[0] == got[1] == got[2]


def test_long_white_space_and_added_tokens():
    for text in (" " * 2_000_000 + "a", "a <|endoftext|>b", "<|endoftext|>"):
        assert packing.check_ids(PATH, text)
    assert packing.token_ids(PATH, "a <|endoftext|>b").tolist() == [64, 220, 50256, 65]


@pytest.mark.parametrize("n", [2048, 64])
def test_packing(docs, empty, n):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = []
    for i, text, *_ in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % n or n, len(ids), n)] if len(ids) > n else [0]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want.append((str(i), k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    got = packing.pack(docs.withColumn("piece", F.lit("x")).withColumn("part", F.lit(1)), PATH, n).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= n
    assert len(seqs) <= -(-sum(w[3] for w in want) // n) + 1
    assert packing.pack(empty, PATH, n).count() == 0


def plain_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(3 * sizes[k] for k in full), [k for k in names if k not in full]
        t = {k: rest * w[k] / sum(w[x] for x in open_) for k in open_}
        over = {k for k in open_ if t[k] > 3 * sizes[k]}
        if not over:
            return t | {k: 3.0 * sizes[k] for k in full}
        full |= over


def many(seed=4, n=900):
    r = random.Random(seed)
    return [(k, prose(k, r.choice([0, 3, 20, 60, 200])), "en", r.choice(["a", "b", "b", "b", "B", "é", None, "tiny"] if k % 50 else ["tiny2"]), k) for k in range(n)]


def test_mixing(spark, empty):
    rows = many() + [(5000, None, None, "a", 1), (None, "x y", None, "b", 1), (7, "x y z", "en", "zero", 1), (7, "x y z", "en", "zero", 1), (5001, "", "en", "none", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix_takes(df).collect()
    assert len(got) == len(rows)
    sizes, where = {}, {}
    for i, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        where.setdefault((i, len((t or "").split())), []).append(s)
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = where[(r["doc_id"], r["size"])][0]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]), (s, taken[s], want[s])
    assert sorted(map(str, mixing.mix_takes(df.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mix_takes(empty).count() == 0
    wordless = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], SCHEMA)
    assert [(r["target"], r["taken"]) for r in mixing.mix_takes(wordless).collect()] == [(0.0, 0), (0.0, 0)]


def test_mixed_corpus_repeats_what_the_plan_takes(spark, empty):
    df = spark.createDataFrame(many(), SCHEMA).withColumn("cuts", F.lit(1)).withColumn("SHARD", F.lit(2))
    plan = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_takes(df).collect() if r["size"]}
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {i: n.get(i, 0) for i in plan} == plan
    assert mixing.mix_documents(empty).count() == 0


def test_split_is_exact_and_hypergeometric(spark):
    q = spark.createDataFrame([("a", 30), ("b", 10), ("c", 0), ("d", 61)], "source_key string, q bigint")
    per = {}
    for r in mixing.split_quotas(q, 3, "s").collect():
        per.setdefault(r["source_key"], []).append(r["q"])
        assert r["q"] >= 0
    assert {k: sum(v) for k, v in per.items()} == {"a": 30, "b": 10, "c": 0, "d": 61}
    shards = [sum(x) for x in zip(*(per[k] for k in sorted(per)), strict=True)]
    assert max(shards) - min(shards) <= 3
    draw = mixing._hyper("20L", "8L", "10L", "u")
    got = spark.range(20_000).withColumn("u", (F.col("id") + 0.5) / 20_000).selectExpr(f"{draw} AS k").groupBy("k").count().collect()
    from math import comb

    for r in got:
        assert r["count"] == pytest.approx(20_000 * comb(8, r["k"]) * comb(12, 10 - r["k"]) / comb(20, 10), abs=2)
