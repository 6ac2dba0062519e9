"""The neighbour graph's answers against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import nndescent

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every, k):
    """Ids, ranks and scores by all inner products."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in fine:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in fine if j != i)[:k]
            out.setdefault(i, []).extend((j, -s) for s, j in near)
    return out


def found(df, rows, **how):
    out = {}
    for r in sorted(nndescent.nearest_neighbours(df, **how).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert len(out.setdefault(r["query_id"], [])) + 1 == r["rank"]
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=6).tolist()) for k in range(25)]
    rows += [(100, None), (120, []), (140, [0.0] * 6), (160, [float("nan")] + [1.0] * 5), (180, [None] + [1.0] * 5), (200, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(300 + k, rows[4][1]) for k in range(40)] + [(20, rows[20][1])]  # copies, one at a query's id, and a repeated row
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got, want = found(df, rows, every=20, k=20), brute(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_fewer_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (21, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert {q: [i for i, _ in v] for q, v in found(df, rows, every=20, k=20).items()} == {0: [20, 21], 20: [0, 21]}
    assert nndescent.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nndescent.nearest_neighbours(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0


def test_several_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="1 to 2"):
        nndescent.nearest_neighbours(spark.createDataFrame([(0, [1.0], 0), (1, [1.0, 2.0], 0)], SCHEMA))


def test_recall_over_several_blocks(spark, monkeypatch):
    """Lengths differ, a third are near copies of one vector, and nodes lie in six blocks."""
    monkeypatch.setattr(nndescent, "BLOCK_ROWS", 500)
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 24)) * r.uniform(0.5, 2, size=(3000, 1))
    x[2000:] = x[0] + 0.02 * r.normal(size=(1000, 24))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnRenamed("vec_id", "VEC_ID").withColumns({"pos": F.lit(1), "key": F.lit("k"), "block": F.lit(2), "v": F.lit(0)})
    got = found(df, rows, every=20, k=20)
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.argsort(-s, kind="stable")[:20]
        hits += len(set(top.tolist()) & {i for i, _ in got[q]})
        assert [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
    assert hits / (150 * 20) >= 0.9


def test_tasks_hand_on_arrays_not_rows(spark, monkeypatch):
    """What a step sends is rows of arrays, a few a pair of blocks, however many nodes these hold; the rounds end before their bound."""
    monkeypatch.setattr(nndescent, "BLOCK_ROWS", 500)
    written, table = [], nndescent.table

    def seen(df, label):
        written.append((label, table(df, label)))
        return written[-1][1]

    monkeypatch.setattr(nndescent, "table", seen)
    x = np.random.default_rng(7).normal(size=(3000, 16))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    got = found(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), rows, every=20, k=20)
    want = brute(rows, 20, 20)
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) / (20 * len(want)) >= 0.9
    steps = [(label, df) for label, df in written if label in ("lists", "around", "beams")]
    assert {label for label, _ in steps} == {"lists", "around", "beams"}
    assert max(df.count() for _, df in steps) <= 2 * 6
    assert sum(label == "lists" for label, _ in steps) < nndescent.ROUNDS


def test_best_and_top():
    """Places of the largest, and the best a key, against a plain sort; among many ties, too."""
    r = np.random.default_rng(1)
    for n in (1, 10, 33, 500, 4001):
        for s in (r.normal(size=(17, n)).astype(np.float32), np.ones((17, n), np.float32)):
            i, j = nndescent._top(s, 32)
            for q in range(17):
                assert np.sort(s[q])[::-1][:32].tolist() == np.sort(s[q][j[i == q]])[::-1][:32].tolist()
    key, pos, flag = r.integers(0, 20, 3000).astype(np.int32), r.integers(0, 200, 3000).astype(np.int32), r.random(3000) < 0.3
    score = np.round(np.sin(pos * 1.7 + key), 1).astype(np.float32)
    known = {}
    for k, p, s, f in zip(key.tolist(), pos.tolist(), score.tolist(), flag.tolist(), strict=True):
        known[k, p] = (s, f or known.get((k, p), (0, False))[1])
    want = [(k, p, *known[k, p]) for k in range(20) for _, p in sorted((-s, p) for (o, p), (s, _) in known.items() if o == k)[:32]]
    assert list(zip(*(x.tolist() for x in nndescent._best(key, pos, score, flag, 32)), strict=True)) == want
