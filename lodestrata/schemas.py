"""Declared schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

ENTITIES = (
    "id bigint, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, "
    "doc_comment string, language string, t_valid_from timestamp, t_valid_to timestamp, importance double, source_tool string, "
    "source_hash string, t_ingested_at timestamp, t_last_verified timestamp, access_count bigint"
)
RELATIONS = (
    "id bigint, source_id bigint, target_id bigint, kind string, weight double, t_valid_from timestamp, t_valid_to timestamp, "
    "t_ingested_at timestamp, source_tool string, source_evidence string, confidence double"
)
CONVENTIONS = "id bigint, category string, pattern string, examples array<string>, confidence double, t_ingested_at timestamp"
QUALITY_ISSUES = (
    "id bigint, file_path string, line_start int, line_end int, category string, severity string, message string, rule_id string, "
    "fix_suggestion string, source_tool string, first_seen timestamp, last_seen timestamp, resolved boolean"
)
HOT_OBSERVATIONS = "id bigint, raw_text string, related_symbol string, created_at bigint"
SYMBOL_OCCURRENCES = "symbol string, kind string, file_path string, start_line int, end_line int, role int"
CHUNKS = (
    "id string, file_path string, start_line int, end_line int, content string, language string, symbol_name string, symbol_kind string, "
    "embedding array<float>, token_count int, file_hash string, indexed_at timestamp_ntz"
)
SESSIONS = "session_id string, branch string, created_at bigint, expires_at bigint, files array<string>"
EVENTS = "path string, kind string, at timestamp"
