"""Scalar expressions over names, code and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LSP_SEVERITIES = {1: "high", 2: "medium", 3: "low"}
TYPE_ERROR_SOURCES = ("rust-analyzer", "pyright", "tsserver", "typescript", "mypy")
SERVERS = {"python": "pyright", "rust": "rust-analyzer", "typescript": "tsserver", "go": "gopls", "java": "jdtls", "c": "clangd", "cpp": "clangd"}
ROLES = ((1, "definition"), (2, "import"), (4, "write_access"), (8, "read_access"), (16, "generated"), (32, "test"), (64, "forward_definition"))
# Numeric symbol kinds of the language server protocol folded to entity kinds.
ENTITY_KINDS = {"function": (6, 9, 12), "type": (5, 10, 11, 23), "module": (2, 3, 4), "variable": (7, 8, 13, 14)}
SYMBOL_KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "type_alias", "constant", "module")
CHUNK_KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface")


def qualified_name(path: Column, name: Column, line: Column, column: Column) -> Column:
    return F.concat(path, F.lit("::"), name, F.lit("@"), line.cast("string"), F.lit(":"), column.cast("string"))


def parent_module(qualified: Column) -> Column:
    """The text before the last ``::``, or null."""
    return F.when(F.contains(qualified, F.lit("::")), F.regexp_extract(qualified, r"(?s)^(.*)::", 1))


def _quarter(text: Column) -> Column:
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def entity_tokens(signature: Column, doc: Column, qualified: Column, name: Column) -> Column:
    return _quarter(signature) + _quarter(doc) + _quarter(F.coalesce(qualified, name)) + 8


def hit_tokens(snippet: Column, path: Column) -> Column:
    return _quarter(snippet) + _quarter(path) + 8


def summary_tokens(summary: Column, entries: Column) -> Column:
    return F.floor(F.octet_length(summary) / 4).cast("bigint") + entries * 8


def byte_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("bigint")


def cut_bytes(text: Column, cap: int) -> Column:
    """The longest prefix of at most ``cap`` bytes that ends between characters."""
    raw = text.cast("binary")
    head = F.substring(raw, 1, cap)
    # A UTF-8 sequence that the cut splits: drop its first byte and what follows.
    tail = F.hex(F.substring(head, -4, 4))
    broken = F.when(tail.rlike("(C|D).$"), 1).when(tail.rlike("E.$"), 1).when(tail.rlike("E.[89AB].$"), 2)
    broken = broken.when(tail.rlike("F.$"), 1).when(tail.rlike("F.[89AB].$"), 2).when(tail.rlike("F.[89AB].[89AB].$"), 3).otherwise(0)
    whole = F.octet_length(raw) <= cap
    return F.when(whole, text).otherwise(F.substring(raw, F.lit(1), F.lit(cap) - broken).cast("string"))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line."""
    parts = F.split(text, r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive, end clamped); null if start is 0 or past the end."""
    all_ = lines(text)
    last = F.least(end, F.size(all_))
    ok = (start >= 1) & (start <= F.size(all_)) & (last >= start)
    return F.when(ok, F.array_join(F.slice(all_, F.greatest(start, F.lit(1)), F.greatest(last - start + 1, F.lit(0))), "\n"))


def signature(text: Column, cap: int = 200) -> Column:
    """What stands before the first ``{`` or ``;``, its lines trimmed and joined by spaces."""
    head = F.regexp_extract(text, r"(?s)^([^{;]*)", 1)
    parts = F.filter(F.transform(F.split(head, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return cut_bytes(F.array_join(parts, " "), cap)


def first_lines(text: Column, n: int = 3) -> Column:
    """The first ``n`` lines that aren't blank; the text itself if all are."""
    found = F.slice(F.filter(lines(text), lambda x: F.trim(x) != ""), 1, n)
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(found, "\n"))


def doc_paragraph(doc: Column) -> Column:
    """A doc comment's first paragraph, without white space at its end.

    It ends at the first empty line; in a comment without one, at the first line after its
    first words that holds comment marks (``/ ! *``) and white space only.
    """
    marked = F.regexp_extract(doc, r"(?U)^([\s/!*]*[^\s/!*][^\n]*(?:\n[^\n]*[^\s/!*][^\n]*)*)", 1)
    head = F.when(F.contains(doc, F.lit("\n\n")), F.substring_index(doc, "\n\n", 1)).when(marked != "", marked).otherwise(doc)
    return F.regexp_replace(head, r"(?U)\s+$", "")


def signature_chunk(sig: Column, doc: Column) -> Column:
    """A signature, and the doc comment's first paragraph below a blank line."""
    paragraph = doc_paragraph(F.coalesce(doc, F.lit("")))
    return F.when(paragraph == "", sig).otherwise(F.concat(sig, F.lit("\n\n"), paragraph))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of white-space tokens; 0 if both are empty."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def decision_title(title: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.left(description, F.lit(80)), F.lit(""))


def smart_case(text: Column, pattern: str) -> Column:
    """Ignores case unless the pattern holds an upper-case letter; text from a NUL on doesn't count."""
    literal = "".join(c for k, c in enumerate(pattern) if k == 0 or pattern[k - 1] != "\\")
    flag = "" if any(c.isupper() for c in literal) else "(?i)"
    return F.split(text, "\x00")[0].rlike(flag + pattern)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def like_ascii(text: Column, query: str) -> Column:
    """``LIKE`` that folds A-Z only, with ``%`` and ``_`` as wildcards and no escape character."""
    return ascii_lower(text).like(query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def quality_severity(severity: Column) -> Column:
    out = F.lit("info")
    for code, name in LSP_SEVERITIES.items():
        out = F.when(severity == code, F.lit(name)).otherwise(out)
    return F.when(severity.isNull(), F.lit("medium")).otherwise(out)


def quality_category(severity: Column) -> Column:
    return F.when(severity == 1, F.lit("type_error")).otherwise(F.lit("lint"))


def is_type_error(severity: Column, source: Column, code: Column) -> Column:
    """An error of a type checker, or with a type checker's code; numeric codes never count."""
    return (severity == 1) & (F.coalesce(source.isin(*TYPE_ERROR_SOURCES), F.lit(False)) | F.coalesce(code.rlike("^(E|TS2|TS7|report)"), F.lit(False)))


def mapped(key: Column, table: dict, default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def tag(name: Column, known: tuple[str, ...]) -> Column:
    """The name in lower case, or ``unknown`` if it isn't a known one."""
    return F.when(F.lower(name).isin(*known), F.lower(name)).otherwise(F.lit("unknown"))


def counted(n: Column, one: str, many: str, none: str) -> Column:
    """``1 match``, ``3 matches``, or the text for none."""
    return F.when(n == 0, F.lit(none)).otherwise(F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many)))


def entity_kind(code: Column) -> Column:
    out = F.lit("symbol")
    for name, codes in ENTITY_KINDS.items():
        out = F.when(code.isin(*codes), F.lit(name)).otherwise(out)
    return out


def role_names(bits: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(bits.bitwiseAND(mask) != 0, F.lit(name)) for mask, name in ROLES])), ",")


def decode_range(r: Column) -> tuple[Column, Column]:
    """First and last line from 1: of four numbers the first and third, of three the first; else zeros."""
    up = lambda k: F.greatest(F.get(r, F.lit(k)), F.lit(0)) + 1
    start = F.when(F.size(r).isin(3, 4), up(0)).otherwise(F.lit(0))
    end = F.when(F.size(r) == 4, up(2)).when(F.size(r) == 3, up(0)).otherwise(F.lit(0))
    return start, end


def utc_text(seconds: Column) -> Column:
    """Date and time; a year beyond 9999 is written without the sign that Spark puts before it."""
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("+"))


def expires_at(created: Column, ttl: Column) -> Column:
    """The sum, or the largest number if it overflows."""
    return F.coalesce(F.try_add(created, ttl), F.lit((1 << 63) - 1))


def is_expired(expires: Column, now: Column) -> Column:
    return expires <= now


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(lo1, lo2) <= F.least(hi1, hi2)


def is_trivial_node(kind: Column) -> Column:
    return kind.isin("comment", "line_comment", "block_comment") | F.endswith(kind, F.lit("_list"))


def edge_kind(kind: Column) -> Column:
    return F.when(F.startswith(kind, F.lit("other:")), F.concat(F.lit("Other("), F.substring(kind, 7, 1 << 30), F.lit(")"))).otherwise(F.initcap(kind))


def import_count(text: Column, lang: Column) -> Column:
    """Import statements by line patterns; languages without a pattern have none."""
    patterns = {
        "python": r"(?m)^[ \t]*(?:import|from)[ \t]+[\w.]",
        "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]",
        "go": r'(?m)^[ \t]*(?:import[ \t]+(?:[\w.]+[ \t]+)?"|(?:[\w.]+[ \t]+)?"[^"\n]+"[ \t]*$)',
        "typescript": r"(?m)^[ \t]*import[ \t{*\"']|\brequire\(",
        "javascript": r"(?m)^[ \t]*import[ \t{*\"']|\brequire\(",
    }
    out = F.lit(0)
    for name, pattern in patterns.items():
        out = F.when(lang == name, F.regexp_count(text, F.lit(pattern))).otherwise(out)
    return out
