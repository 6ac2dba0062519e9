"""The corpus pipeline and the registered queries at the smallest scale."""

import os

import pytest
from pyspark.sql import functions as F

from oracle import assert_same, connect

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")


def test_queries_with_sql(spark):
    from lodestrata.llm import oracle, queries

    con = connect("/root/testdata/sf0.001")
    for name, sql in oracle.oracle_sql().items():
        assert_same(queries.queries()[name](spark, "/root/testdata/sf0.001"), con, sql)


def test_stages_feed_each_other(spark):
    import corpus_pipeline
    from lodestrata.llm import gracededup
    from lodestrata.llm.scratch import table
    from test_nearcopies import labels as near_labels

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, table(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        seen[name] = docs
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "mix" and name != "pack":
            assert docs.join(before, docs.columns, "left_anti").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    texts = [r["text"] for r in seen["quality"].collect()]
    assert len({*texts}) == seen["exact"].count() == seen["exact"].select("text").distinct().count()
    alike = near_labels([(r["doc_id"], r["text"]) for r in seen["exact"].collect()])
    assert sorted(r["doc_id"] for r in seen["near"].collect()) == sorted({*alike.values()})
    pieces = seen["pack"]
    assert pieces.select("doc_id").distinct().count() == seen["mix"].select("doc_id").distinct().count()
    assert pieces.where("start = 0").count() == seen["mix"].count()
    assert gracededup.exact_dedup(seen["near"]).where("NOT kept").count() == 0


def test_rows_whose_ids_are_null_or_repeat(spark):
    import corpus_pipeline
    from cases import SCHEMA, corpus
    from lodestrata.llm.scratch import table

    docs = spark.createDataFrame(corpus(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, ""), "test")
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_decides_by_row(spark):
    import corpus_pipeline
    from cases import SCHEMA, prose

    text, other = prose(1, 60), prose(2, 60)
    rows = [(1, text, "a", None, 1), (2, text, "b", "s", 1), (None, text, "c", "s", 1), (None, text, "c", "s", 1), (5, text, "d", "s", 1), (5, other, "e", "s", 1), (None, "x y", "f", "s", 1), (None, "x y", "f", "s", 1)]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((str(r["doc_id"]), r["lang"]) for r in got) == [("1", "a"), ("5", "e"), ("None", "f")]


def test_stages_keep_clashing_columns_and_empty_tables(spark, empty):
    import corpus_pipeline
    from cases import SCHEMA, corpus

    docs = spark.createDataFrame([r for r in corpus() if r[1] and len(r[1]) < 9_000], SCHEMA)
    names = ["kept", "keep_id", "GROUP_SIZE", "text_sha256", "quality_score", "node", "row", "label", "times", "h", "id", "t", "shard", "cuts", "prio"]
    odd = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, "")
        assert got.columns == odd.columns, name
        rows = got.collect()
        assert rows and all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in rows for n in names), name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_the_rest_stands_without_this_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "lodestrata"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestrata/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
