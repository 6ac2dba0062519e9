"""Symbols and chunks of source files.

Python goes through its own grammar; other languages through line patterns, which is an
approximation: nested and multi-line declarations may be missed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "path string, language string, pos int, kind string, name string, start_line int, end_line int, signature string, doc string"
MAX_TOKENS = 512

# Declaration patterns by language; groups give kind and name.
_LINE_PATTERNS = {
    "rust": (
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)", "function"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)\s*:", "constant"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type_alias"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "module"),
    ),
    "typescript": (
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"),
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"),
        (r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if|for|while|switch|return|catch)(\w+)\s*\([^;]*\)\s*(?::\s*[^{;]+)?\{\s*$", "method"),
        (r"^\s*(?:export\s+)?interface\s+(\w+)", "interface"),
        (r"^\s*(?:export\s+)?type\s+(\w+)", "type_alias"),
    ),
    "go": (
        (r"^func\s+(\w+)\s*[\[(]", "function"),
        (r"^func\s+\([^)]*\)\s*(\w+)\s*\(", "method"),
        (r"^type\s+(\w+)\s+struct\b", "struct"),
        (r"^type\s+(\w+)\s+interface\b", "interface"),
        (r"^type\s+(\w+)\s+(?!struct\b|interface\b)", "type_alias"),
    ),
}
_LINE_PATTERNS["javascript"] = _LINE_PATTERNS["typescript"][:3]


def _python(text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    source = text.split("\n")

    def sign(node) -> str:
        first = node.body[0].lineno if node.body else node.lineno
        head = " ".join(x.strip() for x in source[node.lineno - 1 : max(node.lineno, first - 1)])
        return head.split(":\n")[0].rstrip(":").strip().encode()[:200].decode(errors="ignore")

    classes = [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    inside = {id(f) for c in classes for f in c.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))}
    functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    for n in [*sorted(classes, key=lambda n: n.lineno), *sorted(functions, key=lambda n: n.lineno)]:
        kind = "class" if isinstance(n, ast.ClassDef) else "method" if id(n) in inside else "function"
        yield kind, n.name, n.lineno, n.end_lineno, sign(n), ast.get_docstring(n)


def _braces(lines: list[str], start: int) -> int:
    """The line on which the block opened at ``start`` closes."""
    depth, opened = 0, False
    for k in range(start, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        opened = opened or "{" in lines[k]
        if opened and depth <= 0 or not opened and ";" in lines[k]:
            return k
    return start if not opened else len(lines) - 1


def _by_lines(text: str, lang: str) -> Iterator[tuple]:
    lines = text.split("\n")
    blocks = [(k, _braces(lines, k)) for k, x in enumerate(lines) if re.match(r"^\s*(?:unsafe\s+)?(?:impl|trait)\b|^\s*pub(?:\([^)]*\))?\s+trait\b", x)] if lang == "rust" else []
    for pattern, kind in _LINE_PATTERNS.get(lang, ()):
        for k, line in enumerate(lines):
            m = re.match(pattern, line)
            if not m:
                continue
            own = "method" if kind == "function" and any(a < k <= b for a, b in blocks) else kind
            doc, at = [], k - 1
            while at >= 0 and re.match(r"^\s*///?[^/]?", lines[at]):
                doc.append(re.sub(r"^\s*///? ?", "", lines[at]))
                at -= 1
            sig = re.split(r"[{;]", line)[0].strip().encode()[:200].decode(errors="ignore")
            yield own, m[1], k + 1, _braces(lines, k) + 1, sig, "\n".join(reversed(doc)) or None


def symbols_of(text: str, lang: str) -> list[tuple]:
    """(kind, name, first line, last line, signature, doc) in extraction order."""
    return list(_python(text) if lang == "python" else _by_lines(text, lang))


def extract_symbols(files: DataFrame) -> DataFrame:
    """``(path, language, content)`` to a row per declared symbol; other languages have none."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [
                (p, lang, k, *s) for p, lang, text in zip(b["path"], b["language"], b["content"], strict=True) if lang and text for k, s in enumerate(symbols_of(text, lang))
            ]
            yield pd.DataFrame(rows, columns=["path", "language", "pos", "kind", "name", "start_line", "end_line", "signature", "doc"])

    return files.select("path", "language", "content").mapInPandas(run, SYMBOLS)


def chunk_symbols(files: DataFrame, symbols: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A chunk per symbol of a chunkable kind: its lines; too long, its signature form; too long still, cut.

    ``form`` tells which; the id is ``path:first:last``.
    """
    from lodestrata.functions.text import CHUNK_KINDS, byte_tokens, cut_bytes, signature_chunk, slice_lines

    s = symbols.where(F.col("kind").isin(*CHUNK_KINDS)).join(files.select("path", "content"), "path")
    full = slice_lines(F.col("content"), F.col("start_line"), F.col("end_line"))
    short = signature_chunk(F.col("signature"), F.col("doc"))
    s = s.withColumn("full", full).withColumn("short", short)
    form = F.when(byte_tokens(F.col("full")) <= max_tokens, "full").when(byte_tokens(F.col("short")) <= max_tokens, "signature").otherwise("cut")
    s = s.withColumn("form", form)
    body = F.when(F.col("form") == "full", F.col("full")).when(F.col("form") == "signature", F.col("short")).otherwise(cut_bytes(F.col("short"), 4 * max_tokens))
    s = s.withColumn("chunk", body)
    key = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit(":"), F.col("end_line").cast("string"))
    return s.select(key.alias("id"), "path", "start_line", "end_line", F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), F.col("chunk").alias("content"), byte_tokens(F.col("chunk")).alias("tokens"), "form")


def to_entities(symbols: DataFrame) -> DataFrame:
    """Symbols as entity columns: an open validity from the epoch, importance one half."""
    from lodestrata.functions.text import qualified_name

    return symbols.select(
        "kind", "name", qualified_name(F.col("path"), F.col("name"), F.col("start_line"), F.lit(0)).alias("qualified_name"), F.col("path").alias("file_path"),
        "start_line", "end_line", "signature", F.col("doc").alias("doc_comment"), "language", F.lit("1970-01-01").cast("timestamp").alias("t_valid_from"),
        F.lit(None).cast("timestamp").alias("t_valid_to"), F.lit(0.5).alias("importance"), F.lit("tree-sitter").alias("source_tool"), F.sha2("signature", 256).alias("source_hash"),
    )
