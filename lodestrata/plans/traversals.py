"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph, merge
from lodestrata.plans.fixtures import duck

QUERIES, ORACLE = {}, {}


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


def _seeds(t):
    return t.customer.where("c_custkey <= 3").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_custkey").alias("pos"))


def _bfs(direction: str) -> str:
    near, far = ("target", "source") if direction == "upstream" else ("source", "target")
    return f"""RECURSIVE_MARK r AS (SELECT 'n' || CAST(c_custkey AS STRING) AS node, 0 AS depth FROM customer WHERE c_custkey <= 3
UNION SELECT e.{far}, r.depth + 1 FROM r JOIN small_edges e ON e.{near} = r.node WHERE r.depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) > 0"""


def _recursive(sql: str, *inputs: str) -> str:
    return duck(*inputs).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + sql.replace("RECURSIVE_MARK ", "")


for _name, _direction in (("G01_downstream", "downstream"), ("G01_upstream", "upstream")):
    QUERIES[_name] = lambda t, d=_direction: graph.directional_bfs(t.small_edges, _seeds(t), d, 3)
    ORACLE[_name] = _recursive(_bfs(_direction), "small_edges")


def _merged(t):
    return merge.union_edges(t.edges).select("source", "target", "edge_kind", "coupling", "pos")


def _part_seeds(t):
    return t.part.where("p_partkey IN (1, 5)").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_partkey").alias("pos"))


def g02(t):
    out = graph.blast_radius(_merged(t), _part_seeds(t), 2)
    return out.select("node", "depth", F.round("weight", 9).alias("weight"), "parent", "via", F.array_join("path", " ").alias("path"))


QUERIES["G02_blast_radius"] = g02
_U = "u AS (SELECT source, target, edge_kind, max(coupling) AS coupling, min(pos) AS pos FROM edges GROUP BY ALL)"
_SEEDS = "SELECT 'part:' || CAST(p_partkey AS STRING) AS node, 0 AS depth, 1.0::DOUBLE AS weight, NULL::VARCHAR AS parent, NULL::VARCHAR AS via, row_number() OVER (ORDER BY p_partkey) AS q, 'part:' || CAST(p_partkey AS STRING) AS path FROM part WHERE p_partkey IN (1, 5)"


def blast_sql(merged: str, seeds: str) -> str:
    """Two levels of a blast radius in SQL over the CTE ``u``."""
    return f"""{merged}, b AS (SELECT source AS parent, target AS node, coupling, source AS s, target AS g, pos, edge_kind FROM u UNION ALL SELECT target, source, coupling, source, target, pos, edge_kind FROM u),
l0 AS ({seeds}),
c1 AS (SELECT b.node, 1 AS depth, l.weight * b.coupling AS weight, b.parent, b.edge_kind AS via, l.q, b.s, b.g, b.pos, l.path || ' ' || b.node AS path FROM l0 l JOIN b ON b.parent = l.node WHERE b.node NOT IN (SELECT node FROM l0) QUALIFY row_number() OVER (PARTITION BY b.node ORDER BY l.q, b.s, b.g, b.pos) = 1),
l1 AS (SELECT node, depth, weight, parent, via, row_number() OVER (ORDER BY q, s, g, pos, node) AS q, path FROM c1),
l2 AS (SELECT b.node, 2 AS depth, l.weight * b.coupling AS weight, b.parent, b.edge_kind AS via, l.q, l.path || ' ' || b.node AS path FROM l1 l JOIN b ON b.parent = l.node WHERE b.node NOT IN (SELECT node FROM l0 UNION ALL SELECT node FROM l1) QUALIFY row_number() OVER (PARTITION BY b.node ORDER BY l.q, b.s, b.g, b.pos) = 1),
a AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


_G02 = blast_sql(_U, _SEEDS)
ORACLE["G02_blast_radius"] = duck("edges").rstrip() + ", " + _G02 + " SELECT node, depth, round(weight, 9) AS weight, parent, via, path FROM a"

QUERIES["L05_dependency_chains"] = lambda t: graph.dependency_chains(graph.blast_radius(_merged(t), _part_seeds(t), 2))
ORACLE["L05_dependency_chains"] = duck("edges").rstrip() + ", " + _G02 + " SELECT node, depth, array_to_string(list_reverse(string_split(path, ' ')), ' -> ') AS chain FROM a WHERE depth > 0 ORDER BY weight DESC, depth, node LIMIT 10"
QUERIES["L06_impacted"] = lambda t: graph.impacted(graph.blast_radius(_merged(t), _part_seeds(t), 2)).select("node", "depth", F.round("weight", 9).alias("weight"))
ORACLE["L06_impacted"] = duck("edges").rstrip() + ", " + _G02 + " SELECT node, depth, round(weight, 9) AS weight FROM a WHERE depth > 0"
both("A20_modules", lambda t: graph.modules(t.edges), "SELECT source AS module FROM edges UNION SELECT target FROM edges", "edges")


def g03(t):
    e = t.small_edges
    nodes = graph.modules(e).select(F.col("module").alias("node"), F.when(F.col("module") == "n1", 5.0).otherwise(1.0).alias("mass"))
    return graph.personalized_page_rank(nodes, e, rounds=4, tolerance=0.0).select("node", F.round("rank", 9).alias("rank"))


QUERIES["G03_page_rank"] = g03
_RANK = """, n AS (SELECT node, CASE node WHEN 'n1' THEN 5.0 ELSE 1.0 END AS mass FROM (SELECT source AS node FROM small_edges UNION SELECT target FROM small_edges)),
t AS (SELECT count(*) AS n, sum(mass)::DOUBLE AS s FROM n), e AS (SELECT source, target, 1.0 / count(*) OVER (PARTITION BY source) AS share FROM small_edges WHERE source <> target),
d AS (SELECT node FROM n WHERE node NOT IN (SELECT source FROM e)), r0 AS (SELECT node, 1.0::DOUBLE / t.n AS rank FROM n, t)"""
_STEP = """, r{b} AS (SELECT n.node, 0.15 * n.mass / t.s + 0.85 * coalesce(f.flow, 0) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{a} WHERE node IN (SELECT node FROM d)) / t.n AS rank
FROM n CROSS JOIN t LEFT JOIN (SELECT e.target AS node, sum(r.rank * e.share) AS flow FROM e JOIN r{a} r ON r.node = e.source GROUP BY 1) f ON f.node = n.node)"""
ORACLE["G03_page_rank"] = duck("small_edges").rstrip() + _RANK + "".join(_STEP.format(a=k, b=k + 1) for k in range(4)) + " SELECT node, round(rank, 9) AS rank FROM r4"


def g04(t):
    recent = t.entities.where("price >= 2000").select("file_path")
    return graph.repo_map(t.entities, t.relations, recent, budget=8000).select("id", "tokens", "running")


QUERIES["G04_repo_map"] = g04
both("W02_fit_to_budget", lambda t: graph.fit_to_budget(t.entities.withColumn("tokens", F.length("signature") + 8), "tokens", [F.desc("price"), F.asc("id")], 3000).select("id", "tokens", "running"),
     "SELECT id, tokens, CAST(running AS BIGINT) AS running FROM (SELECT id, CAST(length(signature) + 8 AS INT) AS tokens, sum(length(signature) + 8) OVER (ORDER BY price DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM entities) WHERE running <= 3000", "entities")
