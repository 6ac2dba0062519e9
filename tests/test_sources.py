import pytest
from pyspark.sql import functions as F

from lodestrata.functions import parsing
from lodestrata.operators.snapshots import VersionedTable
from lodestrata.sources import files

PY = '''import os
from a import b


class C(Base):
    """Doc of C."""

    def m(self, x):
        """First.

        Rest."""
        return x


def f(a,
      b):
    return a
'''
RS = "/// Adds.\npub fn add(a: u8) -> u8 {\n    a\n}\nstruct P { x: u8 }\nimpl P {\n    fn get(&self) -> u8 {\n        self.x\n    }\n}\n"


@pytest.fixture
def tree(tmp_path):
    for name, body in {"src/a.py": PY, "src/b.rs": RS, "target/x.rs": "fn no() {}", ".git/y.py": "x", "README.md": "text", "deep/a/b/c.go": "package c", "src/n.py": "The\x00the\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(tmp_path)


def test_walk_search_and_languages(spark, tree):
    w = files.walk_sources(spark, tree)
    assert [r["relative"] for r in w.collect()] == ["deep/a/b/c.go", "src/a.py", "src/b.rs", "src/n.py"]
    assert files.count_capped(w, 2) == 3
    hits = files.text_search(w.select(F.col("relative").alias("path"), "content"), "fn ")
    assert [(r["path"], r["line"]) for r in hits.collect()] == [("src/b.rs", 2), ("src/b.rs", 7)]
    assert files.text_search(w.select(F.col("relative").alias("path"), "content"), "the", 5).count() == 1
    found = files.detect_languages(w.select(F.col("relative").alias("path")))
    assert [r["language"] for r in found.collect()] == ["python", "rust"]


def test_gitignore(spark):
    p = spark.createDataFrame([(x,) for x in ("a.log", "b/a.log", "keep.log", "build/x", "src/build/y", "doc/t.txt")], "path string")
    out = p.where(~files.ignored(F.col("path"), ["# c", "*.log", "!keep.log", "build/", "/doc"]))
    assert [r["path"] for r in out.collect()] == ["keep.log"]


def test_symbols_and_chunks(spark, tree):
    w = files.walk_sources(spark, tree).select(F.col("relative").alias("path"), "language", "content")
    s = parsing.extract_symbols(w)
    got = {(r["path"], r["name"]): (r["kind"], r["start_line"], r["end_line"]) for r in s.collect()}
    assert got[("src/a.py", "C")] == ("class", 5, 12) and got[("src/a.py", "m")][0] == "method" and got[("src/a.py", "f")] == ("function", 15, 17)
    assert got[("src/b.rs", "add")] == ("function", 2, 4) and got[("src/b.rs", "get")][0] == "method" and got[("src/b.rs", "P")][0] == "struct"
    chunks = {r["symbol_name"]: r for r in parsing.chunk_symbols(w, s, max_tokens=12).collect()}
    assert chunks["add"]["form"] == "full" and chunks["add"]["id"] == "src/b.rs:2:4"
    assert chunks["C"]["form"] == "signature" and "Doc of C." in chunks["C"]["content"]
    e = parsing.to_entities(s).where("name = 'add'").first()
    assert e["doc_comment"] == "Adds." and e["importance"] == 0.5 and e["t_valid_to"] is None


def test_broken_python_has_no_symbols():
    assert parsing.symbols_of("def (", "python") == [] and parsing.symbols_of("x", "ruby") == []


def test_text_protocols(spark):
    w = spark.createDataFrame([(1, "worktree /a\nHEAD s1\nbranch refs/heads/m\n\nworktree /b\nHEAD s2\ndetached\n")], "id int, content string")
    assert sorted((r["path"], r["branch"], r["sha"]) for r in files.worktrees(w).collect()) == [("/a", "m", "s1"), ("/b", None, "s2")]
    p = spark.createDataFrame([(1, "3 before\nFile: x.rs\n 12 a\nnote\n</r>\n 5 b\nFile: y\n7 c\n8 d")], "id int, content string")
    assert [(r["file_path"], r["line"], r["snippet"]) for r in files.probe_hits(p, 2).collect()] == [("x.rs", 12, "a"), ("y", 7, "c")]


def test_manifests(spark, tmp_path):
    (tmp_path / "b.toml").write_text('[plugin]\nname="b"\n[capabilities]\nlanguages=["rust"]\nprovides=["search"]\n[activation]\non_language=["rust"]\n')
    (tmp_path / "a.toml").write_text('[plugin]\nname="a"\n')
    m = files.discover_manifests(spark, str(tmp_path))
    assert [r["name"] for r in m.collect()] == ["a", "b"]
    assert [r["name"] for r in files.activated(m, lang="go").collect()] == ["a"]
    with pytest.raises(ValueError):
        files.parse_manifest('[plugin]\nname="x"\n[capabilities]\nlanguages=["go"]\n[activation]\non_language=["c"]')
    assert files.parse_store_config("")["dim"] == 768


def test_parse_cache(spark, tmp_path):
    cache = files.ParseCache(VersionedTable(spark, f"file://{tmp_path}/cache"))
    cache.put(spark.createDataFrame([("a", 1, "s1"), ("b", 1, "s2")], cache.schema))
    cache.put(spark.createDataFrame([("a", 1, "s3")], cache.schema))
    ask = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "path string, mtime bigint")
    assert sorted((r["path"], r["mtime"], r["symbols"]) for r in cache.get(ask).collect()) == [("a", 1, "s3"), ("a", 2, None), ("b", 1, "s2")]
    cache.invalidate(spark.createDataFrame([("a",)], "path string"))
    assert cache.get(ask).where("symbols is not null").count() == 1


def test_state():
    assert files.restore_state(None, "m") == {"last_commit": None, "branch": "m"}
    assert files.restore_state(files.state_json("c", "m"), "x") == {"last_commit": "c", "branch": "m"}
    with pytest.raises(ValueError):
        files.restore_state("{", "m")
