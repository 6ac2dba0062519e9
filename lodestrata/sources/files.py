"""Files, manifests and text protocols as tables."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.paths import WALK_CAP, component_order, language, project_relative, walk_keeps


def walk_sources(spark: SparkSession, root: str, cap: int = WALK_CAP, contents: bool = True) -> DataFrame:
    """``(path, relative, language, content, mtime)`` of the source files below ``root``, in path order, at most ``cap``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    base = "/" + root.split("://")[-1].replace("file:", "").strip("/")
    rows = raw.select(plain.alias("path"), F.col("modificationTime").alias("mtime"), *(["content"] if contents else []))
    rows = rows.withColumn("relative", project_relative(F.col("path"), base)).where(walk_keeps(F.col("relative")))
    rows = rows.withColumn("language", language(F.col("path"))).orderBy(component_order("relative")).limit(cap)
    return rows.withColumn("content", F.decode("content", "UTF-8")) if contents else rows


def count_capped(files: DataFrame, cap: int) -> int:
    """The number of rows, or ``cap + 1`` if there are more."""
    return files.limit(cap + 1).count()


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether gitignore-like patterns exclude a relative path; the last that fits decides, ``!`` includes again."""
    import re

    out = F.lit(False)
    for p in patterns:
        p = p.rstrip()
        if not p or p.startswith("#"):
            continue
        keep, p = p.startswith("!"), p.removeprefix("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        body = "".join(".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.split(r"(\*\*|\*|\?)", p))
        rx = ("^" if anchored else "(^|.*/)") + body + ("/.*$" if folder else "(/.*)?$")
        out = F.when(path.rlike(rx), F.lit(not keep)).otherwise(out)
    return out


def text_search(files: DataFrame, pattern: str, cap: int | None = None, root: str = "") -> DataFrame:
    """``(path, content)`` to matching lines ``(path, line, preview)`` in path and line order; previews hold 1024 bytes."""
    from lodestrata.functions.text import cut_bytes, lines, smart_case

    body = F.split(F.col("content"), "\x00")[0]
    hits = files.select("path", F.posexplode(lines(body)).alias("p", "text")).where(smart_case(F.col("text"), pattern))
    hits = hits.select("path", (F.col("p") + 1).alias("line"), cut_bytes(F.col("text"), 1024).alias("preview"))
    return hits.orderBy(component_order("path"), "line").limit(cap) if cap is not None else hits


def detect_languages(files: DataFrame) -> DataFrame:
    """The sorted languages that markers or extensions at most two folders down show, from ``(path)``."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    seen = F.forall(parts, lambda p: ~F.startswith(p, F.lit(".")) & ~p.isin("node_modules", "target")) & (F.size(parts) <= 3)
    low = F.lower(name)
    by = (("go", "go.mod", r"\.go$"), ("python", "pyproject.toml", r"\.py$"), ("rust", "Cargo.toml", r"\.rs$"), ("typescript", "package.json", r"\.tsx?$"))
    found = [F.when((name == marker) | low.rlike("." + rx), F.lit(lang)) for lang, marker, rx in by]
    return files.where(seen).select(F.explode(F.array_compact(F.array(*found))).alias("language")).distinct().orderBy("language")


def worktrees(text: DataFrame) -> DataFrame:
    """``(id, content)`` listings of work trees to ``(id, path, branch, sha)``; a detached tree has no branch."""
    block = text.select("id", F.explode(F.split("content", "\n\n+")).alias("b"))
    get = lambda rx: F.nullif(F.regexp_extract("b", rx, 1), F.lit(""))
    out = block.select("id", get(r"(?m)^worktree (.+)$").alias("path"), get(r"(?m)^branch (?:refs/heads/)?(.+)$").alias("branch"), get(r"(?m)^HEAD (\S+)$").alias("sha"))
    return out.where("path IS NOT NULL")


def probe_hits(text: DataFrame, cap: int) -> DataFrame:
    """``(id, content)`` tagged search output to ``(id, file_path, line, snippet)``.

    ``File: <path>`` names the file of the numbered lines that follow, until a closing tag;
    other lines are ignored. At most ``cap`` hits an id.
    """
    from pyspark.sql import Window

    rows = text.select("id", F.posexplode(F.split("content", "\n")).alias("pos", "t"))
    tag = F.when(F.col("t").rlike(r"^\s*File:\s*\S"), F.regexp_extract("t", r"^\s*File:\s*(.+?)\s*$", 1)).when(F.col("t").rlike(r"^\s*</"), F.lit(""))
    w = Window.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("file_path", F.last(tag, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where((F.col("file_path") != "") & F.col("t").rlike(r"^\s*\d+\s"))
    rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    return rows.select("id", "file_path", F.regexp_extract("t", r"^\s*(\d+)", 1).cast("int").alias("line"), F.regexp_extract("t", r"^\s*\d+\s(.*)$", 1).alias("snippet"))


def load_occurrences(documents: DataFrame, externals: DataFrame) -> DataFrame:
    """``(path, symbols array<struct<symbol,kind>>, occurrences array<struct<symbol,range,roles>>)`` to symbol rows.

    A document's own kinds override ``externals(symbol, kind)``; empty symbols are dropped
    and an unknown kind is ''.
    """
    from lodestrata.functions.text import decode_range

    own = documents.select(F.explode("symbols").alias("s")).select(F.col("s.symbol").alias("symbol"), F.col("s.kind").alias("kind"), F.lit(1).alias("_own"))
    kinds = own.unionByName(externals.select("symbol", "kind", F.lit(0).alias("_own")))
    kinds = kinds.groupBy("symbol").agg(F.max_by("kind", F.struct("_own", "kind")).alias("kind"))
    rows = documents.select("path", F.explode("occurrences").alias("o")).select(F.col("o.symbol").alias("symbol"), F.col("path").alias("file_path"), "o.range", F.col("o.roles").alias("role")).where("symbol <> ''")
    start, end = decode_range(F.col("range"))
    return rows.join(kinds, "symbol", "left").select("symbol", F.coalesce("kind", F.lit("")).alias("kind"), "file_path", start.alias("start_line"), end.alias("end_line"), "role")


def query_symbol(occurrences: DataFrame, symbol: str) -> DataFrame:
    from lodestrata.functions.text import like_ascii

    return occurrences.where(like_ascii(F.col("symbol"), f"%{symbol}%")).orderBy("file_path", "start_line")


class ParseCache:
    """Parsed symbols keyed by (path, mtime) in a versioned table."""

    def __init__(self, versions):
        self.versions = versions
        self.schema = "path string, mtime bigint, symbols string"

    def get(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.versions.read(self.schema), ["path", "mtime"], "left")

    def put(self, rows: DataFrame) -> None:
        kept = self.versions.read(self.schema).join(rows.select("path", "mtime"), ["path", "mtime"], "left_anti")
        self.versions.commit(kept.unionByName(rows.select("path", "mtime", "symbols")))

    def invalidate(self, paths: DataFrame) -> None:
        self.versions.commit(self.versions.read(self.schema).join(paths.select("path"), "path", "left_anti"))


# ---- plugin manifests


def parse_manifest(text: str) -> dict:
    """A plugin's manifest, checked: a name, and activation languages among the declared ones."""
    m = tomllib.loads(text)
    plugin, able = m.get("plugin", {}), m.get("capabilities", {})
    if not plugin.get("name"):
        raise ValueError("a manifest needs plugin.name")
    active = able.get("activation", m.get("activation", {}))
    stray = set(active.get("on_language", [])) - set(able.get("languages", []))
    if able.get("languages") and stray:
        raise ValueError(f"activation languages not declared: {sorted(stray)}")
    return {"name": plugin["name"], "version": plugin.get("version", ""), "languages": able.get("languages", []), "provides": able.get("provides", []), "on_language": active.get("on_language", []), "on_tool": active.get("on_tool", [])}


MANIFESTS = "name string, version string, languages array<string>, provides array<string>, on_language array<string>, on_tool array<string>"


def discover_manifests(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.toml").load(folder).select(F.decode("content", "UTF-8").alias("t"))
    parse = F.udf(lambda t: parse_manifest(t), f"struct<{MANIFESTS.replace(' array', ':array').replace(' string', ':string')}>")
    return raw.select(parse("t").alias("m")).select("m.*").orderBy("name")


def activated(manifests: DataFrame, lang: str | None = None, tool: str | None = None) -> DataFrame:
    """An empty list activates for everything."""
    out = manifests
    for column, value in (("on_language", lang), ("on_tool", tool)):
        if value is not None:
            out = out.where((F.size(column) == 0) | F.array_contains(column, value))
    return out


def parse_store_config(text: str) -> dict:
    v = tomllib.loads(text).get("vector_store", {})
    return {"backend": v.get("backend", "lancedb"), "model": v.get("model", ""), "dim": v.get("dim", 768), "max_tokens": v.get("max_tokens", 512)}


def state_json(commit: str | None, branch: str) -> str:
    return json.dumps({"last_commit": commit, "branch": branch}, sort_keys=True)


def restore_state(text: str | None, branch: str) -> dict:
    """What was recorded; a new state if nothing was. Broken text is an error."""
    return json.loads(text) if text is not None else {"last_commit": None, "branch": branch}
