"""What a caller's stated reason says: intent, action, domains, gaps, and the query's type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata import dims


def _padded(reason: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(reason, F.lit(""))), F.lit(" "))


def _first(text: Column, rules, default: str) -> Column:
    """The name of the first rule of which a word occurs."""
    out = F.lit(default)
    for name, words in reversed(rules):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w))
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def intent(reason: Column) -> Column:
    return _first(_padded(reason), dims.INTENT_WORDS, "understand")


def action(reason: Column) -> Column:
    return _first(_padded(reason), dims.ACTION_WORDS, "read")


def domains(reason: Column) -> Column:
    """Vocabulary words in order of first occurrence."""
    parts = F.split(F.lower(F.coalesce(reason, F.lit(""))), r"(?U)[\s,.;:!?()]")
    return F.array_distinct(F.filter(parts, lambda p: p.isin(*dims.DOMAIN_WORDS)))


def gaps(reason: Column) -> Column:
    """What follows a gap phrase, up to 40 plain characters, trimmed; distinct in order."""
    pattern = "(" + "|".join(dims.GAP_PHRASES) + r")([a-z0-9_\- ]{0,40})"
    found = F.regexp_extract_all(F.lower(F.coalesce(reason, F.lit(""))), F.lit(pattern), F.lit(2))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def query_type(tool: Column, reason: Column) -> Column:
    out = _first(_padded(reason), [(q, (w,)) for w, q in dims.KEYWORD_QUERY_TYPES], "understand_code")
    for name, q in dims.TOOL_QUERY_TYPES.items():
        out = F.when(tool == name, F.lit(q)).otherwise(out)
    return out
