"""Path columns: order by component, branch names, languages by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by extension, for each consumer.
PARSER_LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyi"), "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"),
    "go": ("go",), "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "ruby": ("rb",), "bash": ("sh", "bash"), "json": ("json",),
}
INGEST_LANGUAGES = PARSER_LANGUAGES | {"python": ("py",), "typescript": ("ts", "tsx")}
CHECK_LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyi"), "typescript": ("ts", "tsx", "js", "jsx", "mts", "cts"), "go": ("go",), "java": ("java",),
    "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
}
# What the repository walk takes and skips, and how many files it stops at.
WALK_EXTENSIONS = ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "c", "cpp", "cc", "h", "hpp")
WALK_SKIPS = ("target", "node_modules", "dist", "build", "venv", "__pycache__")  # besides all dot-names
WALK_CAP = 50_000


def component_order(path: Column | str) -> Column:
    """Sorts ``a/z`` before ``a-b/c``: by component, not by byte."""
    return F.split(path, "/")


def normalise(path: Column) -> Column:
    """One spelling a path: repeated slashes, inner ``.`` components and a last slash removed."""
    plain = F.regexp_replace(path, r"/+", "/")
    plain = F.regexp_replace(plain, r"/(\./)+", "/")
    return F.when(plain == "/", plain).otherwise(F.regexp_replace(plain, r"(?<=.)(/\.)?/?$", ""))


def branch_folder(branch: Column) -> Column:
    return F.regexp_replace(branch, "/", "-")


def extension(path: Column) -> Column:
    """The lower-case extension, or null: a leading dot alone is a name, not an extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.element_at(F.split(name, r"\."), -1)))


def language(path: Column, table: dict[str, tuple[str, ...]] = PARSER_LANGUAGES) -> Column:
    ext, out = extension(path), F.lit(None).cast("string")
    for name, exts in table.items():
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return out


def walk_keeps(path: Column) -> Column:
    """A relative path that the repository walk visits: no dot-names, no build folders, a known extension."""
    parts = F.split(path, "/")
    fine = F.forall(parts, lambda p: ~F.startswith(p, F.lit(".")) & ~p.isin(*WALK_SKIPS))
    return fine & extension(path).isin(*WALK_EXTENSIONS)


def project_relative(path: Column, root: str) -> Column:
    """The part below ``root``, else the path as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
