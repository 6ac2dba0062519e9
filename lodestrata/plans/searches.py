"""Queries over indexes and many patterns at once, and of clustering in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import ivfpq, keywords
from lodestrata.plans.fixtures import duck
from lodestrata.session import stored
from lodestrata.streaming import jobs

QUERIES, ORACLE = {}, {}


def both(name: str, spark, sql: str, *inputs: str) -> None:
    QUERIES[name] = spark
    ORACLE[name] = (duck(*inputs) if inputs else "") + sql


def v02(t):
    chunks = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    asked = chunks.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("v"))  # the stated query set
    return ivfpq.search(ivfpq.build(chunks), asked, 10).withColumn("distance", F.round("distance", 6))


QUERIES["V02_index_search"] = v02  # approximate; its recall is tested


def j07(t):
    first = F.lower(F.element_at(F.split("line", " "), 1))
    words = t.lines.select(first.alias("word")).where("length(word) BETWEEN 3 AND 12")
    return keywords.containing(t.documents.select("doc_id", F.lower("text").alias("text")), words, ident="doc_id")


both("J07_keywords", j07, """, k AS (SELECT DISTINCT lower(string_split(line, ' ')[1]) AS word FROM lines WHERE length(lower(string_split(line, ' ')[1])) BETWEEN 3 AND 12)
SELECT doc_id, word FROM documents JOIN k ON contains(lower(text), word)""", "lines")


def f04(t):
    patterns = t.entities.select(F.concat(F.lit("%"), F.upper(F.substring("qualified_name", 3, 6)), F.lit("_%")).alias("pattern")).distinct()
    short = t.symbols.select(F.concat(F.lit("%#"), F.substring("symbol", -1, 1)).alias("pattern")).distinct()
    asked = patterns.unionByName(short)
    found = keywords.like_many(t.entities, asked, "id", "name", "qualified_name")
    return keywords.newest_of_each(found, t.entities, 50).select("pattern", "rank", "id", "qualified_name")


both("F04_search_by_names", f04, """, p AS (SELECT DISTINCT '%' || upper(substr(qualified_name, 3, 6)) || '_%' AS pattern FROM entities UNION SELECT DISTINCT '%#' || right(symbol, 1) FROM symbols)
SELECT pattern, CAST(row_number() OVER (PARTITION BY pattern ORDER BY t_ingested_at DESC, id DESC) AS INT) AS rank, id, qualified_name FROM p JOIN entities ON lower(name) LIKE lower(pattern) OR lower(qualified_name) LIKE lower(pattern) QUALIFY rank <= 50""", "entities", "symbols")


def f09(t):
    seen = t.occurrences.select(F.monotonically_increasing_id().alias("row"), "symbol", "file_path", F.col("a").alias("start_line"))
    seen = stored(seen, "occurrences")  # the rows' numbers hold for both uses
    asked = t.occurrences.select(F.concat(F.lit("%"), F.upper("symbol"), F.lit("%")).alias("pattern")).where("symbol LIKE '%#1'").distinct()
    return keywords.like_many(seen, asked, "row", "symbol").join(seen, "row").drop("row")


both("F09_query_symbols", f09, """, p AS (SELECT DISTINCT '%' || upper(symbol) || '%' AS pattern FROM occurrences WHERE symbol LIKE '%#1')
SELECT pattern, symbol, file_path, a AS start_line FROM p JOIN occurrences ON lower(symbol) LIKE lower(pattern)""", "occurrences")


def _observations(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"), F.concat_ws("/", "source", "lang").alias("related_symbol"), F.col("doc_id").alias("created_at"))


# The serial order, a row a step: a symbol's leaders so far are carried along.
_CLUSTERED = r"""WITH RECURSIVE o AS (SELECT doc_id AS id, text, source || '/' || lang AS symbol, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents),
r AS (SELECT symbol, n, id, id AS leader, [{'id': id, 'w': w}] AS led FROM o WHERE n = 1
  UNION ALL SELECT symbol, n, id, coalesce(first, id), CASE WHEN first IS NULL THEN list_append(led, {'id': id, 'w': w}) ELSE led END FROM
  (SELECT o.symbol, o.n, o.id, o.w, r.led, list_filter(r.led, lambda l: len(o.w) > 0 AND len(list_intersect(l.w, o.w)) >= 0.9 * (len(l.w) + len(o.w) - len(list_intersect(l.w, o.w))))[1].id AS first FROM r JOIN o ON o.symbol = r.symbol AND o.n = r.n + 1)),
c AS (SELECT r.id, r.leader, o.symbol AS related_symbol, o.text FROM r JOIN o USING (id))
"""
both("A12_cluster_observations", lambda t: jobs.cluster_observations(_observations(t)).select("id", "related_symbol", "leader"), _CLUSTERED + "SELECT id, related_symbol, leader FROM c")
both("A13_promote_observations", lambda t: jobs.promoted_clusters(_observations(t)).withColumn("summary", F.md5("summary")),
     _CLUSTERED + """SELECT leader, md5(arg_max(text, (strlen(text), id))) AS summary, min(id) AS first_at, max(id) AS last_at, CAST(to_json(list_sort(list_distinct(list(related_symbol)))) AS STRING) AS symbols, count(*) AS n, CAST(0.6 AS DOUBLE) AS confidence FROM c GROUP BY leader""")
