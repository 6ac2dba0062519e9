"""Retention, roll-up, import and incremental queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import snapshots, upkeep
from lodestrata.plans.fixtures import duck
from lodestrata.streaming import jobs

QUERIES, ORACLE = {}, {}


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


def z02(t):
    rows = upkeep.relevant(t.facts, F.col("confidence") / 100, F.col("entity") / 150, F.lit(0.5), F.col("observed") / 1e6)
    return rows.select("entity", "observed", F.round("relevance", 9).alias("relevance"))


both("Z02_relevant", z02, """SELECT entity, observed, round(r, 9) AS relevance FROM (SELECT *, 0.3 * (confidence / 100) + 0.4 * (entity / 150) + 0.2 * 0.5 + 0.1 * (observed / 1e6) AS r FROM facts) WHERE r > 0.3""", "facts")

_KINDS = "CASE event_id % 5 WHEN 0 THEN 'entity' WHEN 1 THEN 'observation' WHEN 2 THEN 'decision' WHEN 3 THEN 'issue' ELSE 'convention' END"
_STORE = f"""SELECT event_id AS id, {_KINDS} AS kind, value / 100 AS importance, CAST(event_id % 97 AS INT) AS since_day, CASE WHEN event_id % 10 = 0 THEN CAST(event_id % 91 AS INT) END AS dead_day, CAST(event_id % 6 AS INT) AS access_count, CASE WHEN event_id % 2 = 1 THEN CAST(90 + event_id % 10 AS INT) END AS resolved_day FROM events"""


def z03(t):
    rows = t.sql(_STORE.replace("FROM events", "FROM {events}"))
    kept = upkeep.compact(rows, F.col("kind"), F.lit(100))
    return kept.select("id", "kind", F.round("importance", 9).alias("importance"), "flagged")


_Z03 = f"""WITH s AS ({_STORE}), d AS (SELECT *, CASE WHEN kind = 'entity' AND dead_day IS NOT NULL THEN importance * pow(0.9, 100 - dead_day) WHEN kind = 'entity' THEN importance * pow(0.99, 100 - since_day)
  WHEN kind = 'decision' THEN greatest(importance * pow(0.999, 100 - since_day), 0.3) WHEN kind = 'observation' THEN importance * pow(0.95, 100 - since_day) ELSE importance END AS v FROM s)
"""
both("Z03_compact", z03, _Z03 + """SELECT id, kind, round(v, 9) AS importance, kind = 'entity' AND dead_day IS NULL AND v < 0.1 AS flagged FROM d
WHERE NOT (kind = 'entity' AND dead_day IS NOT NULL AND v < 0.05) AND NOT (kind = 'observation' AND v < 0.1 AND access_count < 3) AND NOT (kind = 'issue' AND coalesce(100 - resolved_day > 7, false))""")


def z03_edges(t):
    kept = upkeep.compact(t.sql(_STORE.replace("FROM events", "FROM {events}")), F.col("kind"), F.lit(100))
    return upkeep.without_ends(t.relations, kept).select("id", "source_id", "target_id", "kind")


both("Z03_relations_left", z03_edges, ", " + _Z03.removeprefix("WITH ").rstrip() + """, k AS (SELECT id FROM d WHERE NOT (kind = 'entity' AND dead_day IS NOT NULL AND v < 0.05) AND NOT (kind = 'observation' AND v < 0.1 AND access_count < 3) AND NOT (kind = 'issue' AND coalesce(100 - resolved_day > 7, false)))
SELECT id, source_id, target_id, kind FROM relations WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)""", "relations")


def _signals(t):
    return t.events.select("event_id", F.col("event_type").alias("bonus_type"), F.when(F.col("event_id") % 3 == 0, "used").otherwise("ignored").alias("signal"), F.col("value").alias("delta"), F.col("ts").alias("at"))


def z06(t):
    s = _signals(t)
    months, _ = upkeep.roll_up_signals(s, F.lit("2024-02-20").cast("date"))
    return months.select(F.col("month").cast("timestamp_ntz").alias("month"), "bonus_type", "signal", "n", F.round("delta", 4).alias("delta"))


def z06_raw(t):
    latest = F.to_date(F.lit(t.events.agg(F.max("ts")).first()[0]))
    return upkeep.roll_up_signals(_signals(t), F.date_sub(latest, -20))[1].select("event_id", "signal")


both("Z06_signals_by_month", z06, """SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, event_type AS bonus_type, CASE WHEN event_id % 3 = 0 THEN 'used' ELSE 'ignored' END AS signal, count(*) AS n, round(sum(value), 4) AS delta FROM events GROUP BY ALL""")
both("Z06_signals_kept", z06_raw, """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'used' ELSE 'ignored' END AS signal FROM events WHERE CAST((SELECT max(ts) FROM events) AS DATE) + 20 - CAST(ts AS DATE) <= 30""")


def z05(t):
    calls = t.events.select(F.col("event_type").alias("tool"), F.col("ts").alias("at"), F.col("value").alias("elapsed_ms"), (F.col("event_id") % 3 == 0).alias("hit"))
    return upkeep.latency_over(upkeep.daily_sketches(calls), F.lit("1970-01-01").cast("date"), F.lit("9999-01-01").cast("date"))


QUERIES["Z05_latency_sketched"] = z05  # within a rank error; tested against exact percentiles
both("Z05_sketched_counts", lambda t: z05(t).select("tool", "calls", F.round("hit_rate", 9).alias("hit_rate")), "SELECT event_type AS tool, count(*) AS calls, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM events GROUP BY ALL")

# Two stores that share some entities: ours are the parts of small size, theirs those of odd size with other ids.
_MINE = "SELECT min(id) AS id, qualified_name, file_path, min(signature) AS value, 'kg' AS authority, CAST(0.5 AS DOUBLE) AS confidence FROM entities WHERE start_line IS NULL OR start_line < 30 GROUP BY qualified_name, file_path"
_THEIRS = "SELECT min(id) + 500000 AS id, qualified_name, file_path, max(signature) AS value, CASE WHEN min(id) % 3 = 0 THEN 'lsp_ast' ELSE 'text' END AS authority, CAST(0.7 AS DOUBLE) AS confidence FROM entities WHERE end_line % 2 = 0 GROUP BY qualified_name, file_path"


def _stores(t):
    return t.spark.sql(_MINE.replace("FROM entities", "FROM {e}"), e=t.entities), t.spark.sql(_THEIRS.replace("FROM entities", "FROM {e}"), e=t.entities)


def z07(t):
    return upkeep.merge_entities(*_stores(t))[0]


_MERGED = f""", m AS ({_MINE}), h AS ({_THEIRS}), top AS (SELECT max(id) AS top FROM m),
n AS (SELECT row_number() OVER (ORDER BY h.qualified_name, h.file_path) + top AS id, h.* EXCLUDE (id), h.id AS their_id FROM h, top WHERE NOT EXISTS (FROM m WHERE m.qualified_name = h.qualified_name AND m.file_path = h.file_path)),
x AS (SELECT m.id, m.qualified_name, m.file_path, CASE WHEN h.authority = 'lsp_ast' THEN h.value ELSE m.value END AS value, CASE WHEN h.authority = 'lsp_ast' THEN h.authority ELSE m.authority END AS authority, CASE WHEN h.authority = 'lsp_ast' THEN h.confidence ELSE m.confidence END AS confidence, h.id AS their_id
  FROM m LEFT JOIN h USING (qualified_name, file_path)), a AS (SELECT * FROM x UNION ALL SELECT id, qualified_name, file_path, value, authority, confidence, their_id FROM n)
"""
both("Z07_merge_entities", z07, _MERGED + "SELECT * EXCLUDE (their_id) FROM a", "entities")


def z07_edges(t):
    mine, theirs = _stores(t)
    ids = upkeep.merge_entities(mine, theirs)[1]
    edges = t.relations.select("id", "source_id", "target_id", "kind")
    return upkeep.merge_relations(edges, edges.select(F.col("source_id") + 500000, F.col("target_id") + 500000, "kind").toDF("source_id", "target_id", "kind"), ids)


both("Z07_merge_relations", z07_edges, _MERGED.rstrip() + """, r AS (SELECT id, source_id, target_id, kind FROM relations), k AS (SELECT max(id) AS top FROM r),
w AS (SELECT DISTINCT s.id AS source_id, d.id AS target_id, r.kind FROM r JOIN a s ON s.their_id = r.source_id + 500000 JOIN a d ON d.their_id = r.target_id + 500000)
SELECT * FROM r UNION ALL SELECT row_number() OVER (ORDER BY source_id, target_id, kind) + top, source_id, target_id, kind FROM w, k WHERE NOT EXISTS (FROM r WHERE r.source_id = w.source_id AND r.target_id = w.target_id AND r.kind = w.kind)""", "entities", "relations")


def x10(t):
    """Orders feed customers, customers nations, nations regions; each holds the greatest price band below it."""
    band = F.floor(F.col("o_totalprice") / 25000)
    o = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), band.alias("value"), F.concat(F.lit("c"), "o_custkey").alias("up"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("up"))
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("up"))
    edges = o.select(F.col("node").alias("source"), F.col("up").alias("target"), F.lit(1).alias("level"))
    edges = edges.unionByName(c.select(F.col("node").alias("source"), F.col("up").alias("target"), F.lit(2).alias("level"))).unionByName(n.select(F.col("node").alias("source"), F.col("up").alias("target"), F.lit(3).alias("level")))
    one = o.groupBy(F.col("up").alias("node")).agg(F.max("value").alias("value"))
    two = c.join(one, "node").groupBy(F.col("up").alias("node")).agg(F.max("value").alias("value"))
    three = n.join(two, "node").groupBy(F.col("up").alias("node")).agg(F.max("value").alias("value"))
    values = o.select("node", "value").unionByName(one).unionByName(two).unionByName(three)
    changed = o.where("substring(node, -1) IN ('3', '7')").select("node", F.greatest(F.col("value") - 2, F.lit(0)).alias("value"))
    return upkeep.propagate(values, edges, changed, F.max, 3)


both("X10_propagate", x10, """WITH o AS (SELECT 'o' || o_orderkey AS node, CAST(floor(o_totalprice / 25000) AS BIGINT) AS old, CASE WHEN o_orderkey % 10 IN (3, 7) THEN greatest(CAST(floor(o_totalprice / 25000) AS BIGINT) - 2, 0) ELSE CAST(floor(o_totalprice / 25000) AS BIGINT) END AS value, o_custkey FROM orders),
c AS (SELECT 'c' || o_custkey AS node, max(old) AS old, max(value) AS value, bool_or(old <> value) AS hit, o_custkey FROM o GROUP BY o_custkey),
n AS (SELECT 'n' || c_nationkey AS node, max(old) AS old, max(value) AS value, bool_or(old <> value) AS hit, c_nationkey FROM c JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
r AS (SELECT 'r' || n_regionkey AS node, max(old) AS old, max(value) AS value, bool_or(old <> value) AS hit FROM n JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey)
SELECT node, 0 AS level, old, value FROM o WHERE old <> value UNION ALL SELECT node, 1, old, value FROM c WHERE hit UNION ALL SELECT node, 2, old, value FROM n WHERE hit UNION ALL SELECT node, 3, old, value FROM r WHERE hit""")

_RULES = [("", 0, "target/"), ("", 1, "*.json"), ("", 2, "# a comment"), ("", 3, "*1.rs"), ("src", 0, "*.go"), ("src", 1, "!1-*.go"), ("a", 0, "/b-c/*.java"), ("a/node_modules", 0, "*"), ("a/node_modules/x", 0, "!*.rs"), ("lib", 0, "!*1.rs"), ("lib", 1, "?-M*")]


def s02(t):
    rules = t.spark.createDataFrame(_RULES, "folder string, pos int, pattern string")
    return upkeep.ignored_paths(t.paths, rules)


# The same rules spelt out one by one.
_GONE = " OR ".join(
    [
        "path LIKE 'target/%'",
        "(path LIKE '%.json' AND path NOT LIKE 'target/%')",
        "(path LIKE '%1.rs' AND path NOT LIKE 'lib/%')",
        "(regexp_matches(path, '^src/.*\\.go$') AND NOT regexp_matches(path, '^src/1-[^/]*\\.go$'))",
        "regexp_matches(path, '^a/b-c/[^/]*\\.java$')",
        "path LIKE 'a/node_modules/%'",
        "regexp_matches(path, '^lib/[^/]-M[^/]*$')",
    ]
)
both("S02_ignored", s02, f"SELECT DISTINCT path FROM paths WHERE {_GONE}", "paths")


def d02(t):
    r = t.relations.select("id", "source_id", "target_id", "kind", "weight")
    known = r.where("id % 3 <> 0").groupBy("source_id", "target_id", "kind").agg(F.min("id").alias("id"), F.min("weight").alias("weight")).withColumn("t_last_verified", F.lit(1).cast("bigint"))
    new = r.where("id % 2 = 0").withColumn("id", F.col("id") + 1000000)
    return snapshots.upsert_relations(known.select("id", "source_id", "target_id", "kind", "weight", "t_last_verified"), new, F.lit(9).cast("bigint"))


both("D02_upsert_relations", d02, """, c AS (SELECT source_id, target_id, kind, min(id) AS id, min(weight) AS weight FROM relations WHERE id % 3 <> 0 GROUP BY ALL), n AS (SELECT source_id, target_id, kind, min(id) + 1000000 AS id, max(weight) AS weight FROM relations WHERE id % 2 = 0 GROUP BY ALL)
SELECT coalesce(c.id, n.id) AS id, source_id, target_id, kind, CASE WHEN c.id IS NULL THEN n.weight WHEN n.id IS NULL THEN c.weight ELSE greatest(c.weight, n.weight) END AS weight, CAST(CASE WHEN n.id IS NULL THEN 1 ELSE 9 END AS BIGINT) AS t_last_verified FROM c FULL JOIN n USING (source_id, target_id, kind)""", "relations")


def d03(t):
    s = t.hot_signals
    known = s.where("id % 2 = 0").select("id", F.col("pattern").alias("category"), F.col("pattern_hash").alias("pattern"), F.lit(0.5).alias("confidence"), F.lit(1).cast("bigint").alias("t_ingested_at"))
    new = s.where("id % 7 = 0").groupBy(F.col("pattern").alias("category"), F.col("pattern_hash").alias("pattern")).agg((F.count("*") / 100).alias("confidence"))
    return snapshots.insert_conventions(known, new, F.lit(9).cast("bigint"))


both("D03_insert_conventions", d03, """, k AS (SELECT id, pattern AS category, pattern_hash AS pattern, CAST(0.5 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS t_ingested_at FROM hot_signals WHERE id % 2 = 0),
n AS (SELECT pattern AS category, pattern_hash AS pattern, count(*) / 100 AS confidence FROM hot_signals WHERE id % 7 = 0 GROUP BY ALL)
SELECT * FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY category, pattern, confidence), category, pattern, confidence, 9 FROM n""", "hot_signals")


def x06(t):
    """The batch after the even ids were promoted: the 256 oldest others, and what they are promoted to."""
    return jobs.promote_unpromoted(t.hot_signals, t.hot_signals.where("id % 2 = 0"), lambda b: jobs.promote_conventions(b, 2))


_X06 = ", b AS (SELECT * FROM hot_signals WHERE id % 2 <> 0 ORDER BY id LIMIT 256)"
both("X06_promoted", lambda t: x06(t)[0], _X06 + " SELECT pattern_hash, count(*) AS n, arg_min(pattern, id) AS pattern, 'Pattern observed in ' || count(*) || ' files' AS description FROM b GROUP BY pattern_hash HAVING count(*) >= 2", "hot_signals")
both("X06_marked", lambda t: x06(t)[1], _X06 + " SELECT id FROM b", "hot_signals")


def l09(t):
    """Touched files by the last touch: a touch of a file that waits already moves it up."""
    touched = t.calls.select(F.concat_ws("/", "session_id", "file").alias("path"), "at")
    return jobs.recent_paths(touched, 50).withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), "path")))


both("L09_priority_queue", l09, """SELECT *, CAST(row_number() OVER (ORDER BY "at" DESC, path) AS INT) AS place FROM (SELECT session_id || '/' || file AS path, max("at") AS "at" FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)""", "calls")
