"""Near copies against brute force over word tuples."""

import os
import random

import pytest
from cases import SCHEMA, corpus, prose, spread

from lodestrata.llm import nearcopies


def plain_shingles(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def with_changes(text, changed):
    """``changed`` words in a row replaced in the middle: 4 more shingles than words change."""
    words = text.split(" ")
    at = len(words) // 2
    words[at : at + changed] = [f"new{changed}x{k}" for k in range(changed)]
    return " ".join(words)


def copies():
    """Per text a copy at Jaccard 0.95, 0.9, 0.85, 0.8 and just below 0.8, and texts around one common passage."""
    rows = []
    for k, changed in enumerate([4, 12, 27, 40, 41]):
        text = prose(500 + k, 400)
        rows += [(10 * k, text, "en", "s", 0), (10 * k + 1, with_changes(text, changed), "en", "s", 0)]
    passage = prose(600, 60)
    rows += [(100 + k, f"{passage} {prose(700 + k, random.Random(k).randint(1, 60))}", "en", "s", 0) for k in range(60)]
    chain = prose(800, 300)
    for k in range(4):  # each near the one before it, the last far from the first
        rows.append((200 + k, chain, "en", "s", 0))
        words = chain.split(" ")
        words[60 * k : 60 * k + 16] = [f"c{k}x{j}" for j in range(16)]
        chain = " ".join(words)
    return rows


def labels(rows):
    sets = [(i, plain_shingles(t)) for i, t, *_ in rows]
    return spread([(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k:] if alike(x, y)])


def test_every_pair_from_four_fifths_on_is_linked(spark):
    rows = copies()
    want = labels(rows)
    assert [want[10 * k + 1] == 10 * k for k in range(5)] == [True] * 4 + [False]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["id"]: r["component_id"] for r in nearcopies.near_components(df).collect()} == want


def test_the_near_stage_drops_copies_from_four_fifths_on(spark):
    import corpus_pipeline

    rows = copies()
    want = sorted(i for i, least in labels(rows).items() if i == least)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == want


def test_null_and_repeated_ids_and_empty_texts(spark, empty):
    rows = [r for r in corpus() if r[0] is not None]
    got = nearcopies.near_components(spark.createDataFrame(corpus(), SCHEMA)).collect()
    assert len(got) == len(corpus())
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == labels(rows)
    assert nearcopies.near_components(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_given_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    want = labels([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect())
    assert got == sorted({*want.values()})


def test_the_search_sees_only_texts_that_share_enough(spark, monkeypatch):
    """Texts that have a passage in common with one other are left out before they are compared; every near copy stays."""
    rows = [(k, f"{prose(1000 + k, 150)} {prose(2000 + k // 2, 40)}", "en", "s", 0) for k in range(200)]
    rows += [(300 + i, t, *rest) for i, t, *rest in copies()[:10]]
    seen, table = {}, nearcopies.table

    def kept(df, label):
        return seen.setdefault(label, table(df, label))

    monkeypatch.setattr(nearcopies, "table", lambda df, label: kept(df, label) if label == "near-shared" else table(df, label))
    got = nearcopies.near_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["id"]: r["component_id"] for r in got} == labels(rows)
    assert 0 < seen["near-shared"].select("node").distinct().count() <= 40


def test_lone_texts_have_no_near_copy(monkeypatch):
    """Chunks, parts and both size classes against brute force over hashes; a chunk of which a row is missing loses no text."""
    import numpy as np
    import pyarrow as pa

    from lodestrata.llm import shares

    monkeypatch.setattr(shares, "CHUNK", 3_000)
    r = np.random.default_rng(7)
    sets = []
    for n in [1, 2, 5, 9, 40, 100, 126, 127, 128, 140, 158, 160, 161, 400, 900] * 3:
        h = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        sets.append(h)
        drop = int(r.integers(0, n // 4 + 1))
        sets += [h[drop:], np.unique(np.concatenate([h, r.integers(0, 1 << 64, n // 4, dtype=np.uint64)]))][: int(r.integers(0, 3))]
    sets.append(np.zeros(0, np.uint64))
    parts = 4
    sent = [x.slice(k, 1) for x in shares._sent(enumerate(sets), parts) for k in range(parts)]
    by_part = [pa.Table.from_batches([x]).to_batches()[0] for x in sorted(sent, key=lambda x: x["part"][0].as_py())]
    shared = sorted(shares._shared(iter(by_part)), key=lambda x: x["chunk"][0].as_py())
    lone = {x for b in shares._lone(iter(shared), parts) for x in b["node"].to_pylist()}
    alike_ = {a for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and x.size and 9 * np.intersect1d(x, y).size >= 4 * (x.size + y.size)}
    assert alike_ and not lone & alike_
    assert {a for a, x in enumerate(sets) if x.size and not any(np.intersect1d(x, y).size for b, y in enumerate(sets) if a != b)} <= lone
    less = {x for b in shares._lone(iter(shared[1:]), parts) for x in b["node"].to_pylist()}
    assert less < lone
