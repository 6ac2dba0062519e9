"""Operator inputs derived from the driver's tables, as SQL that Spark and DuckDB both run.

``{table}`` stands for a base table. ``lines`` is the one input whose SQL differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestrata.session import ready

_LINES = {
    "spark": "SELECT doc_id, source AS corpus, source || '/' || lang || '/' || CAST(doc_id AS STRING) AS file_path, CAST(p + 1 AS INT) AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS p, line",
    "duck": "SELECT doc_id, corpus, file_path, CAST(line_no AS INT) AS line_no, line FROM (SELECT doc_id, source AS corpus, source || '/' || lang || '/' || CAST(doc_id AS STRING) AS file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {documents})",
}

SQL = {
    "hits": """
SELECT source, rank, file_path, line_no AS start_line, line_no AS end_line, line AS snippet FROM (
  SELECT 'ripgrep' AS source, *, CAST(row_number() OVER (PARTITION BY corpus ORDER BY doc_id, line_no) AS INT) AS rank FROM {lines} WHERE lower(line) LIKE '%the%'
  UNION ALL
  SELECT 'probe' AS source, *, CAST(row_number() OVER (PARTITION BY corpus ORDER BY length(line) DESC, doc_id, line_no) AS INT) AS rank FROM {lines} WHERE lower(line) LIKE '%the%'
  UNION ALL
  SELECT 'lancedb' AS source, *, CAST(row_number() OVER (PARTITION BY corpus ORDER BY (doc_id * 31 + line_no * 17) % 1000, doc_id, line_no) AS INT) AS rank FROM {lines} WHERE lower(line) LIKE '%an%'
) h""",
    "group_hits": """
SELECT CASE source WHEN 'ripgrep' THEN 'G1' WHEN 'probe' THEN 'G2' ELSE 'G6' END AS grp, CASE source WHEN 'lancedb' THEN 'timed_out' ELSE 'available' END AS status,
  rank, file_path, start_line, end_line, snippet FROM {hits}""",
    "fields": """
SELECT CASE event_id % 5 WHEN 0 THEN 'serena' WHEN 1 THEN 'tree-sitter' WHEN 2 THEN 'ast-grep' WHEN 3 THEN 'diagnostics' ELSE 'scip' END AS source, event_id AS pos,
  'f' || CAST(user_id AS STRING) AS file_path, CAST(event_id % 4 AS INT) AS start_line, CAST(event_id % 4 + 3 AS INT) AS end_line, event_type AS field, 'v' || CAST(event_id % 3 AS STRING) AS value FROM {events}""",
    "facts": "SELECT 's' || CAST(event_id % 3 AS STRING) AS source_id, user_id AS entity, event_type AS fact, value AS confidence, CAST(event_id % 977 AS BIGINT) * 1000 AS observed FROM {events}",
    "edges": """
SELECT 'part:' || CAST(l_partkey AS STRING) AS source, 'supplier:' || CAST(l_suppkey AS STRING) AS target, l_returnflag AS edge_kind, 'src_' || l_linestatus AS source_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'ground_truth' ELSE 'inferred' END AS origin, 1 - l_discount AS coupling,
  ((l_orderkey * 8 + l_linenumber) * 64 + CAST(floor(l_quantity) AS BIGINT)) * 10000 + CAST(floor(l_extendedprice) AS BIGINT) % 10000 AS pos FROM {lineitem}""",
    "small_edges": "SELECT DISTINCT 'n' || CAST(o_custkey AS STRING) AS source, 'n' || CAST((o_orderkey * 7 + 3) % 5000 AS STRING) AS target FROM {orders}",
    "chunks": """
SELECT 'c' || CAST(event_id % 3 AS STRING) AS source_id, 'p/' || CAST(user_id AS STRING) || '/' || event_type AS path, value AS pagerank,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 500 AS BIGINT) END AS tokens, event_id AS pos FROM {events}""",
    "source_status": "SELECT 'c' || CAST(n_nationkey AS STRING) AS source_id, CASE WHEN n_nationkey = 1 THEN 'errored' ELSE 'available' END AS status FROM {nation} WHERE n_nationkey < 3",
    "context_files": "SELECT 'p/' || CAST(user_id AS STRING) || '/view' AS path FROM {events} WHERE user_id % 4 = 0 UNION SELECT 'p/' || CAST(user_id AS STRING) || '/' || event_type FROM {events} WHERE event_id % 400 = 0",
    "issues": """
SELECT 'tool' || CAST(event_id % 3 AS STRING) AS source_tool, 'src/' || CAST(user_id AS STRING) || '.py' AS file_path, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 20 AS INT) END AS line_start,
  event_type AS category, CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, 'm' || CAST(event_id % 7 AS STRING) AS message,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'R' || CAST(event_id % 6 AS STRING) END AS rule_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'fix' || CAST(event_id % 5 AS STRING) END AS fix, event_id AS pos FROM {events}""",
    "tests": """
SELECT 'tests/t' || CAST(o_custkey % 300 AS STRING) AS test_path, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'src/s' || CAST(o_orderkey % 50 AS STRING) END AS source_path,
  CASE o_orderkey % 3 WHEN 0 THEN 'convention' WHEN 1 THEN 'import' ELSE 'kg_relations' END AS method, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence FROM {orders}""",
    "tiered": """
SELECT event_type || CAST(user_id AS STRING) AS value, CASE event_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier, value AS confidence, CAST(event_id % 1009 AS BIGINT) AS observed_at, event_id AS pos FROM {events}""",
    "candidates": """
SELECT o_custkey AS key, o_orderkey AS pos, 'v' || CAST(o_orderkey % 2 AS STRING) AS value, CASE o_orderkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'scip' WHEN 2 THEN 'text' ELSE 'lsp_ast' END AS authority,
  CAST(o_orderkey % 5 AS DOUBLE) / 10 AS confidence FROM {orders}""",
    "entities": """
SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' ELSE 'module' END AS kind, p_brand AS name,
  p_type || '::' || p_brand || CAST(p_partkey % 40 AS STRING) AS qualified_name, 'src/' || p_type || '.rs' AS file_path, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS start_line, p_size + 5 AS end_line,
  p_name AS signature, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name || p_brand END AS doc_comment, CAST(p_partkey * 7919 % 97 AS BIGINT) AS t_ingested_at, p_retailprice AS price FROM {part}""",
    "relations": """
SELECT o_orderkey AS id, o_custkey AS source_id, (o_orderkey * 7 + 3) % 2500 AS target_id, CASE o_orderkey % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' ELSE 'inherits' END AS kind,
  0.5 + CAST(o_orderkey % 5 AS DOUBLE) / 10 AS weight FROM {orders}""",
    "history": """
SELECT o_orderkey AS id, o_custkey AS customer, o_orderpriority AS priority, o_orderdate AS t_valid_from,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN lead(o_orderdate, 3) OVER v ELSE lead(o_orderdate) OVER v END AS t_valid_to FROM {orders} WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "probes": "SELECT c_custkey AS customer, TIMESTAMP_NTZ '1995-06-15 00:00:00' AS at FROM {customer}",
    "symbols": "SELECT DISTINCT p_brand AS symbol FROM {part}",
    "reasons": """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'find_similar' WHEN 1 THEN 'blast_radius' ELSE 'other' END AS tool,
  CASE event_id % 11 WHEN 0 THEN 'Please refactor the Rust daemon, search' WHEN 1 THEN 'FIX crash in SQL; unsure about vector ranking! ok' WHEN 2 THEN 'implement a plugin (docker)'
    WHEN 3 THEN 'look at this pr' WHEN 4 THEN 'I don''t know how tokio works, need to learn async rust. and git' WHEN 5 THEN 'explain fusion fusion Ranking' WHEN 6 THEN NULL WHEN 7 THEN 'what is affected'
    WHEN 8 THEN 'unfamiliar with lsp_bridge-x unfamiliar with   ' WHEN 9 THEN 'add address seed' ELSE 'describe the weather' END || CASE WHEN event_id % 2 = 0 THEN ' now' ELSE '' END AS reason FROM {events}""",
    "bonuses": """
SELECT CAST(user_id AS STRING) AS session_id, event_id AS bonus_id, CASE event_id % 5 WHEN 0 THEN 'pitfall' WHEN 1 THEN 'convention' WHEN 2 THEN 'related_code' WHEN 3 THEN 'quality_issue' ELSE 'test' END AS bonus_type,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'f' || CAST(event_id % 10 AS STRING) END AS file_path, CAST(event_id % 50 AS INT) AS line_lo, CAST(event_id % 50 + 5 AS INT) AS line_hi, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'Key' || CAST(event_id % 6 AS STRING) END AS keyword FROM {events}""",
    "edits": "SELECT CAST(c_custkey AS STRING) AS session_id, 'f' || CAST(c_custkey % 10 AS STRING) AS file_path, CAST(c_custkey % 40 AS INT) AS lo, CAST(c_custkey % 40 + 8 AS INT) AS hi, 'uses KEY' || CAST(c_custkey % 6 AS STRING) AS content FROM {customer}",
    "issue_table": """
SELECT o_orderkey AS id, 'f' || CAST(o_custkey % 60 AS STRING) AS file_path, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS INT) END AS line_start, CASE o_orderkey % 2 WHEN 0 THEN 'lint' ELSE 'type_error' END AS category,
  o_orderpriority AS severity, 'm' || CAST(o_orderkey % 900 AS STRING) AS message, 100 AS first_seen, CAST(o_orderkey % 90 AS INT) AS last_seen, o_orderkey % 3 = 0 AS resolved FROM {orders}""",
    "report": """
SELECT DISTINCT 'f' || CAST(o_custkey % 60 AS STRING) AS file_path, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS INT) END AS line_start, CASE o_orderkey % 2 WHEN 0 THEN 'lint' ELSE 'type_error' END AS category,
  o_orderpriority AS severity, 'm' || CAST((o_orderkey + (o_orderkey % 5) * 1000) % 900 AS STRING) AS message FROM {orders} WHERE o_custkey % 60 < 20 AND o_orderkey % 2 = 0""",
    "reported_files": "SELECT DISTINCT 'f' || CAST(c_custkey % 60 AS STRING) AS file_path FROM {customer} WHERE c_custkey % 60 < 25",
    "hot_signals": "SELECT event_id AS id, event_type || CAST(user_id AS STRING) AS pattern_hash, 'p:' || event_type AS pattern FROM {events}",
    "hot_deltas": "SELECT event_type AS change_type, 'f' || CAST(user_id AS STRING) AS file_path, event_id AS created_at FROM {events}",
    "hot_decisions": "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE 'T' || event_type END AS title, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props || ' because ' || event_type || ' needs a rather long explanation of what was decided and why' END AS description, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'f' || CAST(user_id AS STRING) END AS affected_files FROM {events}",
    "calls": "SELECT CAST(user_id AS STRING) AS session_id, event_id * 60 AS at, event_type AS file FROM {events}",
    "tool_calls": "SELECT event_type AS tool, value AS elapsed_ms, event_id % 3 = 0 AS hit FROM {events}",
    "session_hits": "SELECT CAST(user_id % 20 AS STRING) AS session_id, 'p/' || CAST(user_id AS STRING) || '/' || event_type AS file_path, props AS snippet, value / 1000 AS score, event_id AS pos FROM {events}",
    "session_files": "SELECT CAST(user_id % 20 AS STRING) AS session_id, 'p/' || CAST(user_id AS STRING) || '/click' AS file_path FROM {events} WHERE user_id % 3 = 0",
    "lifecycle": """
SELECT 'plugin' || CAST(user_id AS STRING) AS plugin, event_id AS at, CASE (event_id * 7 + user_id) % 40 WHEN 0 THEN 'stop' WHEN 1 THEN 'fail' WHEN 2 THEN 'wake' ELSE CASE (event_id * 7 + user_id) % 5 WHEN 0 THEN 'register' WHEN 1 THEN 'load' WHEN 2 THEN 'activate' WHEN 3 THEN 'idle' ELSE 'call' END END AS event FROM {events}""",
    "occurrences": """
SELECT event_type || '#' || CAST(user_id AS STRING) AS symbol, 'f' || CAST(user_id AS STRING) AS file_path, CAST(event_id % 50 - 2 AS INT) AS a, CAST(event_id % 50 + 3 AS INT) AS b, CAST(event_id % 3 + 2 AS INT) AS n, CAST(event_id % 128 AS INT) AS role FROM {events}""",
    "paths": """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'target/deps' WHEN 2 THEN '.hidden' WHEN 3 THEN 'a/b-c' WHEN 4 THEN 'lib' ELSE 'a/node_modules/x' END || '/' || o_orderpriority || CAST(o_custkey % 50 AS STRING) ||
  CASE o_orderkey % 13 WHEN 0 THEN '.rs' WHEN 1 THEN '.PY' WHEN 2 THEN '.pyi' WHEN 3 THEN '.tsx' WHEN 4 THEN '.mjs' WHEN 5 THEN '.go' WHEN 6 THEN '.java' WHEN 7 THEN '.h' WHEN 8 THEN '.hpp' WHEN 9 THEN '.rb' WHEN 10 THEN '.json' WHEN 11 THEN '' ELSE '.mts' END AS path FROM {orders}""",
    "diagnostics": """
SELECT event_id AS id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS severity, CASE event_id % 4 WHEN 0 THEN 'pyright' WHEN 1 THEN 'eslint' WHEN 2 THEN NULL ELSE 'mypy' END AS source,
  CASE event_id % 7 WHEN 0 THEN 'E0308' WHEN 1 THEN 'TS2304' WHEN 2 THEN 'TS6133' WHEN 3 THEN 'reportX' WHEN 4 THEN NULL ELSE 'W1' END AS code FROM {events}""",
}


def _expand(name: str, dialect: str) -> str:
    text = _LINES[dialect] if name == "lines" else SQL[name]
    if dialect == "duck":
        text = text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")

    def put(m: re.Match) -> str:
        return f"({_expand(m[1], dialect)})" if m[1] in SQL or m[1] == "lines" else m[0]

    return re.sub(r"\{(\w+)\}", put, text)


class Tables:
    """Base tables and derived inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ready(spark), sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name != "lines" and name not in SQL:
            return self.base(name)
        return self.sql(_expand(name, "spark"))

    def sql(self, text: str) -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{t: self.base(t) for t in used})


def duck(*names: str) -> str:
    """A WITH clause that defines the inputs for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', _expand(n, 'duck'))})" for n in names) + "\n"
