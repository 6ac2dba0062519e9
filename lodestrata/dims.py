"""Fixed dimensions: weights, authorities, severities, vocabularies and name maps.

Everything in capitals here is a fixed value that results depend on.
"""

from __future__ import annotations

RRF_K = 60

# Weights of the search sources, in rank order of the sources.
SEARCH_WEIGHTS = {"ripgrep": 1.5, "probe": 2.0, "lancedb": 1.5, "zoekt": 1.0, "codedb": 1.0}

# Query types, and the weights of groups G1 to G8 for each.
GROUPS = ("G1", "G2", "G3", "G4", "G5", "G6", "G7", "G8")
GROUP_WEIGHTS = {
    "understand_code": (2.0, 1.0, 2.5, 1.5, 2.0, 0.5, 1.0, 0.5),
    "find_definition": (3.0, 1.5, 1.0, 0.5, 0.5, 0.0, 0.5, 0.0),
    "find_references": (3.0, 2.0, 0.5, 1.0, 0.5, 0.0, 0.5, 0.0),
    "search_code": (1.5, 3.0, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0),
    "get_context_for_edit": (2.0, 2.0, 1.5, 1.5, 2.5, 0.5, 1.5, 1.0),
    "trace_dependencies": (1.5, 0.5, 1.5, 3.0, 0.5, 0.0, 0.5, 0.0),
    "blast_radius": (1.5, 0.5, 1.5, 3.0, 0.5, 0.5, 1.0, 1.0),
    "review_changes": (1.5, 1.0, 1.5, 1.5, 0.5, 1.0, 3.0, 2.5),
    "check_quality": (1.0, 0.5, 1.0, 1.5, 0.5, 0.5, 3.0, 2.5),
    "remember": (0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}

# The query type that a tool's name stands for.
TOOL_QUERY_TYPES = {
    "understand_code": "understand_code",
    "find_definition": "find_definition",
    "find_references": "find_references",
    "search_code": "search_code",
    "find_similar": "search_code",
    "get_context_for_edit": "get_context_for_edit",
    "get_conventions": "understand_code",
    "trace_dependencies": "trace_dependencies",
    "blast_radius": "blast_radius",
    "review_changes": "review_changes",
    "check_quality": "check_quality",
    "remember": "remember",
}

# Words that give a query its type where the tool's name doesn't; the first that occurs decides.
KEYWORD_QUERY_TYPES = (
    ("definition", "find_definition"),
    ("declared", "find_definition"),
    ("references", "find_references"),
    ("callers", "find_references"),
    ("usages", "find_references"),
    ("blast radius", "blast_radius"),
    ("impact", "blast_radius"),
    ("affected", "blast_radius"),
    ("trace", "trace_dependencies"),
    ("depends on", "trace_dependencies"),
    ("refactor", "get_context_for_edit"),
    ("rename", "get_context_for_edit"),
    ("cleanup", "get_context_for_edit"),
    ("review", "review_changes"),
    ("diff", "review_changes"),
    (" pr ", "review_changes"),
    ("lint", "check_quality"),
    ("quality", "check_quality"),
    ("vulnerab", "check_quality"),
    ("find code", "search_code"),
    ("search", "search_code"),
    ("grep", "search_code"),
    ("remember", "remember"),
    ("save", "remember"),
    ("persist", "remember"),
    ("explain", "understand_code"),
    ("how does", "understand_code"),
    ("what is", "understand_code"),
)

# Intents and actions with their words, in the order they are tried.
INTENT_WORDS = (
    ("refactor", ("refactor", "clean up", "rename", "restructure")),
    ("fix_bug", ("fix", "bug", "broken", "crash", "error")),
    ("add_feature", ("add a feature", "add feature", "new feature", "implement")),
    ("review", ("review", "audit", "diff", " pr ", "pull request")),
    ("understand", ("explain", "understand", "how does", "what is", "why")),
)
ACTION_WORDS = (
    ("edit", ("edit", "modif", "update", "add", "create", "write")),
    ("read", ("read", "look", "check", "inspect", "see")),
    ("explain", ("explain", "describ", "summar", "document")),
)

# The domain vocabulary and the phrases that announce a gap in knowledge.
DOMAIN_WORDS = (
    "rust", "python", "typescript", "async", "tokio", "http", "sql", "sqlite", "lancedb", "mcp", "lsp", "serena", "embeddings",
    "cargo", "git", "docker", "plugin", "daemon", "fusion", "ranking", "search", "vector", "knowledge", "agent", "ceqp",
)
GAP_PHRASES = ("don't know ", "unsure about ", "need to learn ", "unfamiliar with ")

# Authority ranks of structural sources (smaller wins) and of conflicting facts.
FIELD_AUTHORITY = {"serena": 0, "tree-sitter": 1, "ast-grep": 2, "diagnostics": 3, "scip": 4}
FACT_AUTHORITY = ("lsp_ast", "scip", "kg", "text")
TIERS = ("hot", "warm", "cold")
SEVERITIES = ("critical", "high", "medium", "low", "info")
TEST_METHODS = ("convention", "import", "kg_relations")

# Post-hoc feedback, by bonus type: the signal of a hit and its boost; and the decay of a miss.
FEEDBACK = {
    "pitfall": ("used", 0.1),
    "convention": ("followed", 0.05),
    "related_code": ("used", 0.05),
    "quality_issue": ("fixed", 0.1),
    "test": ("used", 0.05),
}
FEEDBACK_DECAY = -0.01
