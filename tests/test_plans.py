import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.operators.snapshots import VersionedTable
from lodestrata.plans import fanout, index, tools

HITS = "rank int, file_path string, start_line int, end_line int, snippet string"


def source(rows):
    return lambda spark, q: spark.createDataFrame(rows, HITS)


def test_registry_and_fan_out(spark):
    r = fanout.Registry()
    r.install("a", "G1", source([(1, "f", 1, 2, "x")]))
    r.install("b", "G2", source([(1, "f", 1, 2, "y")]))
    r.install("c", "G6", lambda spark, q: pytest.fail("weighs nothing, so it isn't asked"))
    r.install("d", "G3", lambda spark, q: 1 / 0)
    rows, status = fanout.fused_query(spark, r, "find_definition", {})
    assert {x["source_id"]: x["status"] for x in status.collect()} == {"a": "available", "b": "available", "d": "errored"}
    assert rows.first()["fused_score"] == pytest.approx(4.5 / 61)
    r.enable("b", False)
    assert fanout.fused_query(spark, r, "find_definition", {})[0].first()["fused_score"] == pytest.approx(3 / 61)
    with pytest.raises(ValueError):
        r.install("a", "G1", source([]))
    r.uninstall("d")
    assert r.names() == ["a", "b", "c"]
    r.enable("a", False)
    assert fanout.fan_out(spark, r, {}, {"G1"})[0] is None


def test_retries():
    pauses, calls = [], []

    def act():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert fanout.run_with_retries(act, 3, 0.5, pauses.append) == "done" and pauses == [0.5, 1.0]
    with pytest.raises(ZeroDivisionError):
        fanout.run_with_retries(lambda: 1 / 0, 2, 0, pauses.append)


def test_ingest_is_idempotent(spark, tmp_path):
    from datetime import datetime

    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n\nclass C:\n    def m(self):\n        pass\n")
    table = VersionedTable(spark, f"file://{tmp_path}/entities")
    one = index.ingest(spark, str(root), table, schemas.ENTITIES, datetime(2024, 1, 1))
    two = index.ingest(spark, str(root), table, schemas.ENTITIES, datetime(2024, 1, 2))
    assert one == two == 3
    got = table.read().collect()
    assert {r["access_count"] for r in got} == {1} and len({r["id"] for r in got}) == 3 and {r["t_last_verified"].day for r in got} == {2}


def test_index_skips_unchanged_and_counts_failures(spark):
    files = spark.createDataFrame([("a.py", "python", "def f():\n    pass\n", 5), ("b.py", "python", "def g():\n    pass\ndef h():\n    pass\n", 6)], "path string, language string, content string, mtime bigint")
    state = spark.createDataFrame([("a.py", 5), ("b.py", 1)], "path string, mtime bigint")
    embed = lambda c: F.when(~F.contains(c, F.lit("h()")), F.array(F.lit(1.0), F.lit(0.0)))
    rows, following, stats = index.index_paths(files, state, embed, 2, "2024-01-01")
    assert [r["symbol_name"] for r in rows.collect()] == ["g"]
    assert {r["path"]: r["mtime"] for r in following.collect()} == {"a.py": 5, "b.py": 6}
    s = stats.first()
    assert (s["scanned"], s["skipped"], s["indexed"], s["inserted"], s["failed"]) == (2, 1, 1, 1, 1)
    with pytest.raises(Exception, match="dim_mismatch"):
        index.index_paths(files, state, embed, 3, "2024-01-01")[0].collect()


def test_tool_arguments():
    assert tools.clamp(None, 10, 1, 100) == 10 and tools.clamp(1000, 10, 1, 100) == 100 and tools.clamp(0, 10, 1, 100) == 1
    assert tools.direction_of("sideways") == ("upstream", "downstream") and tools.direction_of("upstream") == ("upstream",)


def test_remember_appends(spark):
    log = spark.createDataFrame([(4, "a", "s", 1)], schemas.HOT_OBSERVATIONS)
    new = spark.createDataFrame([("c", "s", 3), ("b", "s", 2)], "raw_text string, related_symbol string, created_at bigint")
    got = tools.remember({"observations": log}, new).orderBy("id").collect()
    assert [(r["id"], r["raw_text"]) for r in got] == [(4, "a"), (5, "b"), (6, "c")]
