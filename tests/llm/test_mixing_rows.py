"""Mixing with repeats, null ids, giant documents and many sources."""

import pytest
from cases import SCHEMA, prose
from lodestrata.llm import mixing

WORDS = prose(77, 300)


def totals(rows):
    out = {}
    for r in rows:
        x = out.setdefault((r["source_size"], r["target"]), [0, None])
        x[0] += r["taken"]
        if not r["taken"] and r["size"]:
            x[1] = min(x[1] or r["size"], r["size"])
    return out


def test_rows_with_null_or_one_id_are_drawn_one_by_one(spark):
    few = " ".join(WORDS.split()[:4])
    rows = [(None, few, "en", "a", 1)] * 100 + [(100 + k, few, "en", "b", 1) for k in range(100)] + [(7, few, "en", "c", 1)] * 100 + [(9, f"{few} {k}", "en", "d", 1) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.mix_takes(df).collect()
    for (_, target), (taken, _) in _by_source(got).items():
        assert abs(taken - target) < 5
    assert sorted(map(str, mixing.mix_takes(df.repartition(3)).collect())) == sorted(map(str, got))
    n = mixing.mix_documents(df).count()
    assert n == sum(r["taken"] // r["size"] for r in got)


def _by_source(got):
    out = {}
    for r in got:
        kind = (r["size"], r["doc_id"] if r["doc_id"] in (None, 7, 9) else "k")
        x = out.setdefault((kind, r["target"]), [0, 0])
        x[0] += r["taken"]
    return out


@pytest.mark.parametrize("giant", [20_000, 80_000])
@pytest.mark.parametrize("name", ["a", "q", "zz"])
def test_a_giant_document_does_not_stop_the_cut(spark, giant, name):
    body = " ".join(["w"] * giant)
    rows = [(k, WORDS, "en", name, 1) for k in range(400)] + [(1000, body, "en", name, 1)] + [(2000 + k, WORDS, "en", f"{name}{k % 2}", 1) for k in range(300)]
    got = totals(mixing.mix_takes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    for (_, target), (taken, least) in got.items():
        assert 0 <= target - taken < (least or 301)


def test_many_sources(spark):
    rows = [(k, WORDS, "en", f"s{k % 500:04d}", 1) for k in range(2000)]
    got = mixing.mix_takes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    per = got.groupBy("target", "source_size").sum("taken").collect()
    assert got.count() == 2000 and per
