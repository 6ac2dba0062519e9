"""Promotion, session, life-cycle and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import vector
from lodestrata.plans.fixtures import duck
from lodestrata.streaming import jobs

QUERIES, ORACLE = {}, {}


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


both("A14_promote_conventions", lambda t: jobs.promote_conventions(t.hot_signals),
     "SELECT pattern_hash, count(*) AS n, arg_min(pattern, id) AS pattern, 'Pattern observed in ' || CAST(count(*) AS STRING) || ' files' AS description FROM hot_signals GROUP BY pattern_hash HAVING count(*) >= 3", "hot_signals")
both("A15_promote_architecture", lambda t: jobs.promote_architecture(t.hot_deltas),
     "SELECT change_type, file_path, count(*) AS n, max(created_at) AS last_at, change_type || ' in ' || file_path || ' (' || CAST(count(*) AS STRING) || ')' AS summary FROM hot_deltas GROUP BY change_type, file_path", "hot_deltas")
both("A16_link_decisions", lambda t: jobs.link_decisions(t.hot_decisions), "SELECT id, coalesce(nullif(title, ''), left(description, 80), '') AS title, affected_files FROM hot_decisions WHERE affected_files IS NOT NULL", "hot_decisions")
both("X07_session_state", lambda t: jobs.session_state(t.calls, 300000, 500000),
     """SELECT session_id, min("at") AS created_at, max("at") AS last_at, count(*) AS calls, string_agg(DISTINCT file, ',' ORDER BY file) AS files, min("at") + 300000 AS expires_at, min("at") + 300000 <= 500000 AS expired FROM calls GROUP BY ALL""", "calls")  # fmt: skip
both("X07_sessionise", lambda t: jobs.sessionise(t.events.select("event_id", "user_id", (F.col("event_id") * 60).alias("at")), "user_id", "at", 3600),
     """SELECT event_id, user_id, "at", sum(new) OVER (PARTITION BY user_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM
(SELECT event_id, user_id, event_id * 60 AS "at", CASE WHEN event_id * 60 - lag(event_id * 60) OVER (PARTITION BY user_id ORDER BY event_id) > 3600 THEN 1 ELSE 0 END AS new FROM events)""")
_X08 = """o AS (SELECT plugin, event, row_number() OVER (PARTITION BY plugin ORDER BY "at", event) AS n FROM lifecycle),
f(plugin, n, state, illegal) AS (SELECT DISTINCT plugin, 0, 'discovered', 0 FROM o UNION ALL SELECT f.plugin, f.n + 1,
  CASE WHEN event = 'fail' THEN 'error' WHEN event = 'stop' AND state <> 'error' THEN 'stopped' WHEN event = 'register' AND state = 'discovered' THEN 'registered' WHEN event = 'load' AND state IN ('registered', 'idle') THEN 'loading'
    WHEN event IN ('wake', 'call') AND state = 'idle' THEN 'loading' WHEN event = 'activate' AND state = 'loading' THEN 'active' WHEN event = 'idle' AND state = 'active' THEN 'idle' ELSE state END,
  illegal + CASE event WHEN 'stop' THEN state = 'error' WHEN 'register' THEN state <> 'discovered' WHEN 'load' THEN state NOT IN ('registered', 'idle') WHEN 'wake' THEN state <> 'idle' WHEN 'activate' THEN state <> 'loading' ELSE false END::INT
  FROM f JOIN o ON o.plugin = f.plugin AND o.n = f.n + 1)
SELECT plugin, state, illegal, CAST(n AS INT) AS events FROM f QUALIFY row_number() OVER (PARTITION BY plugin ORDER BY n DESC) = 1"""
QUERIES["X08_fold_lifecycle"] = lambda t: jobs.fold_lifecycle(t.lifecycle)
ORACLE["X08_fold_lifecycle"] = duck("lifecycle").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _X08
both("X13_reap", lambda t: t.calls.groupBy(F.col("session_id").alias("language")).agg(F.max("at").alias("last_used")).where(jobs.reapable(F.col("last_used"), F.lit(600000), 60)),
     'SELECT session_id AS language, max("at") AS last_used FROM calls GROUP BY ALL HAVING 600000 - max("at") >= 60', "calls")


def x01(t):
    e = t.events.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return jobs.debounce(e, "600 seconds").withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


both("X01_debounce", x01, """, e AS (SELECT 'f' || CAST(user_id AS STRING) AS path, event_type AS kind, ts AS "at", CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT path, arg_max(kind, "at") AS kind, count(*) AS n, max("at") AS last_at FROM s GROUP BY path, g""".lstrip(", ").replace("e AS", "WITH e AS", 1))


def x02(t):
    raw = F.when(F.col("event_id") % 4 == 0, "create/file").when(F.col("event_id") % 4 == 1, "modify/name/both").when(F.col("event_id") % 4 == 2, "modify/data").otherwise("access/read")
    return t.events.select("event_id", jobs.event_kind(raw).alias("kind"))


both("X02_event_kind", x02, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'renamed' WHEN 2 THEN 'modified' ELSE 'other' END AS kind FROM events")
both("X12_recent_paths", lambda t: jobs.recent_paths(t.calls.select(F.col("session_id").alias("path"), "at"), 100), 'SELECT session_id AS path, max("at") AS "at" FROM calls GROUP BY ALL ORDER BY "at" DESC, path LIMIT 100', "calls")


def x10(t):
    rows = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    new = t.orders.where("o_orderkey > 50").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority").startswith("1"), "changed").otherwise(F.col("o_orderstatus")).alias("value"))
    return vector.early_cutoff(rows, new)


both("X10_early_cutoff", x10, "SELECT o_orderkey AS key, CASE WHEN o_orderkey <= 50 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey <= 50 OR o_orderpriority LIKE '1%'")


def v07(t):
    f = t.orders.groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderkey").alias("mtime"))
    state = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderkey").alias("mtime"))
    return vector.changed_files(f, state)


both("V07_changed_files", v07, """SELECT f.path, f.mtime FROM (SELECT o_custkey AS path, max(o_orderkey) AS mtime FROM orders GROUP BY 1) f LEFT JOIN (SELECT o_custkey AS path, max(o_orderkey) AS mtime FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s USING (path)
WHERE f.mtime IS DISTINCT FROM s.mtime""")


def q2(t):
    c = t.orders.select((F.col("o_custkey") % 400).alias("id"), F.col("o_orderkey").alias("indexed_at"), F.col("o_orderpriority").alias("file_hash"))
    return vector.newest_chunks(c)


both("V07_newest_chunks", q2, "SELECT o_custkey % 400 AS id, max(o_orderkey) AS indexed_at, arg_max(o_orderpriority, o_orderkey) AS file_hash FROM orders GROUP BY 1")


def z06(t):
    return t.events.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


both("Z06_monthly_rollup", z06, "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
