"""Exact and near deduplication, and connected components, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import corpus, spread
from lodestrata.llm import covertree, gracededup, simhash
from lodestrata.llm.components import components


@pytest.mark.parametrize("kw", [{}, {"memory": 5_000}, {"digest_bytes": 1}, {"digest_bytes": 1, "memory": 5_000}])
def test_exact(docs, kw):
    classes = {}
    for i, t, *_ in corpus():
        classes.setdefault(t or "", []).append(i)
    got = gracededup.exact_dedup(docs, **kw).collect()
    assert len(got) == len(corpus())
    for r in got:
        ids = classes[r["text"] or ""]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (max(known) if known else None)
        assert r["group_size"] == len(ids) and r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_exact_with_clashing_columns(docs, empty):
    odd = docs.withColumn("KEEP_ID", F.lit("mine")).withColumn("digest", F.lit(1)).withColumn("content", F.lit(2)).withColumn("h", F.lit(3))
    got = gracededup.exact_dedup(odd)
    assert got.columns == [*docs.columns, "digest", "content", "h", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.where("digest = 1 AND content = 2 AND h = 3").count() == len(corpus())
    assert got.where("keep_id = 51").count() == 4
    assert gracededup.exact_dedup(empty).count() == 0


def test_tables_that_overflow_compare_contents():
    rows = [(7, bytes([k % 40]) * 500, k, 1) for k in range(400)]  # one hash for all
    out = {}
    with __import__("tempfile").TemporaryDirectory() as folder:
        for t, _ in gracededup._grace(iter(rows), 0, 3_000, folder):
            for c, keep, n in zip(t.contents, t.keeps, t.counts, strict=True):
                assert c not in out
                out[c] = (keep, n)
        assert not __import__("os").listdir(folder)
    assert out == {bytes([k]) * 500: (360 + k, 10) for k in range(40)}


def plain_fingerprint(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_follow_the_definition(spark):
    for _, t, *_ in corpus()[:8] + corpus()[-9:-5] + corpus()[-4:]:
        for n in (4, 5):
            assert simhash.fingerprint(t, n) == plain_fingerprint(t, n)
    one = spark.range(1).select(F.xxhash64(F.lit("a b")).alias("h")).first()["h"]
    assert one & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 6, "sample": 8}])
def test_simhash(docs, empty, kw):
    want = [(i, plain_fingerprint(t, 4)) for i, t, *_ in corpus()]
    rows = range(len(want))
    label = spread([(a, a) for a in rows] + [(a, b) for a in rows for b in rows if (want[a][1] ^ want[b][1]).bit_count() <= 4])
    groups = {}
    for k in rows:
        groups.setdefault(label[k], []).append(want[k][0])
    expect = [(want[k][0], want[k][1], min((i for i in groups[label[k]] if i is not None), default=None)) for k in rows]
    got = simhash.simhash_components(docs, **kw).collect()
    assert sorted(map(str, [(r["id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got])) == sorted(map(str, expect))
    assert simhash.simhash_components(empty, **kw).count() == 0


def test_trees_lose_no_pair():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (900, 3)).astype(np.uint64)
    points = np.unique(np.concatenate([base, base[r.integers(0, 40, 900)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]]))
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 4
    seen = np.zeros_like(near)
    simhash.search(simhash.grow(points, 16), points, 4, lambda q, at: seen.__setitem__(np.ix_(q, at), True))
    assert not (near & ~seen).any() and seen.mean() < 1
    tree, count = simhash.top_tree(points[::3], 9)
    at, home = simhash._reach(tree, points, 0)
    assert count > 4 and sorted(at) == list(range(points.size))
    own = home[np.argsort(at)]
    at, to = simhash._reach(tree, points, 4)
    visits = set(zip(at.tolist(), to.tolist(), strict=True))
    assert all((a, own[b]) in visits for a, b in zip(*np.nonzero(near), strict=True))


def test_components_of_chains_stars_and_repeats(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(500, 500)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)]
    edges += [(b, a) for a, b in edges[:30]] + edges[:10] + [(None, 3), (4, None)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = spread([(a, b) for a, b in edges if a is not None and b is not None and a != b])
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors(seed=0):
    r = np.random.default_rng(seed)
    c = r.normal(size=(12, 16))
    x = np.concatenate([c[r.integers(0, 12, 150)] + r.normal(size=(150, 16)) * r.choice([0.05, 0.2, 0.5], (150, 1)), r.normal(size=(60, 16))])
    rows = [(k, [float(v) for v in x[k].astype(np.float32)], 0) for k in range(len(x))]
    rows += [(300 + k, rows[5][1], 1) for k in range(4)] + [(5, rows[5][1], 2), (310, [2 * v for v in rows[6][1]], 0)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] + [1.0] * 15, 0), (404, [float("inf")] + [1.0] * 15, 0), (405, [None] + [1.0] * 15, 0), (None, rows[7][1], 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [1e30] * 16, 0), (409, [1e-30] * 16, 0)]
    return rows


@pytest.mark.parametrize("block", [4096, 40])
def test_embeddings(spark, block):
    rows = vectors()
    good = [k for k, (_, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {}
    for k in good:
        v = np.asarray(rows[k][1], np.float64)
        v = v / np.abs(v).max()
        unit[k] = v / np.linalg.norm(v)
    pairs = [(a, b) for a in good for b in good if a != b and len(unit[a]) == len(unit[b]) and (rows[a][1] == rows[b][1] or unit[a] @ unit[b] >= 0.95)]
    label = spread(pairs)
    want = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[m][0] for m in label if label[m] == label.get(k, -1) and rows[m][0] is not None] if k in label else [i]
        c = min(ids, default=None) if ids else None
        want.append((str(i), sum(a == k for a, _ in pairs), str(c), i == c))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = covertree.embedding_components(df, block_rows=block).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == sorted(want)


def test_embeddings_of_an_empty_table(spark):
    assert covertree.embedding_components(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    bad = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in covertree.embedding_components(bad).collect()] == [(1, 0, 1, True)]


def test_cover_trees_cover():
    x = covertree.unit([b"d" + np.asarray(v).tobytes() for _, v, _ in vectors()[:210]])
    t = covertree.CoverTree(x)
    above = np.zeros(1, dtype=int)
    for k in range(1, len(t.levels)):
        centers, parent, cover = t.levels[k]
        up = t.levels[k - 1][0]
        assert set(up) <= set(centers)  # nested
        if k < len(t.levels) - 1:
            assert cover.max() <= 2 * 2 / 2**k + 1e-3
        assert (np.linalg.norm(x[centers] - x[up[parent]], axis=1) <= t.levels[k - 1][2][parent] + 1e-9).all()
    del above
