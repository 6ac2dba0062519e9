"""Retention, roll-ups, imports and incremental recomputation of a knowledge store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.context import decay, relevance
from lodestrata.operators.fusion import resolve_conflicts
from lodestrata.operators.graph import numbered
from lodestrata.session import stored

# Daily rates, floors and limits of the decay rules.
DEAD_RATE, DEAD_LEAST, LIVE_RATE, LIVE_FLAG = 0.9, 0.05, 0.99, 0.1
DECISION_RATE, DECISION_FLOOR, OBSERVATION_RATE, OBSERVATION_LEAST, OBSERVATION_USES = 0.999, 0.3, 0.95, 0.1, 3
RESOLVED_DAYS, SIGNAL_DAYS = 7, 30


def relevant(rows: DataFrame, domain: Column, entity: Column, proximity: Column, recency: Column, more_than: float = 0.3) -> DataFrame:
    """``rows`` with ``relevance``, those that exceed the threshold."""
    return rows.withColumn("relevance", relevance(domain, entity, proximity, recency)).where(F.col("relevance") > more_than)


def compact(rows: DataFrame, kind: Column, today: Column) -> DataFrame:
    """The decay rules over ``(importance, since_day, dead_day, access_count, resolved_day)``: kept rows, decayed, with ``flagged``.

    ``kind`` is entity, decision, observation or issue; others are kept as they are. Dead
    entities decay from the day they died, all else from ``since_day``; a null day counts
    as today. Unresolved issues never decay.
    """
    days = F.greatest(today - F.coalesce("since_day", today), F.lit(0))
    dead_days = F.greatest(today - F.col("dead_day"), F.lit(0))
    dead = F.col("dead_day").isNotNull()
    value = F.col("importance")
    out = (
        F.when((kind == "entity") & dead, decay(value, DEAD_RATE, dead_days))
        .when(kind == "entity", decay(value, LIVE_RATE, days))
        .when(kind == "decision", F.greatest(decay(value, DECISION_RATE, days), F.lit(DECISION_FLOOR)))
        .when(kind == "observation", decay(value, OBSERVATION_RATE, days))
        .otherwise(value)
    )
    new = F.col("_new")
    gone = (kind == "entity") & dead & (new < DEAD_LEAST)
    gone = gone | (kind == "observation") & (new < OBSERVATION_LEAST) & (F.coalesce("access_count", F.lit(0)) < OBSERVATION_USES)
    gone = gone | (kind == "issue") & (today - F.col("resolved_day") > RESOLVED_DAYS)
    kept = rows.withColumn("_new", out).where(~F.coalesce(gone, F.lit(False)))
    flagged = F.coalesce((kind == "entity") & ~dead & (new < LIVE_FLAG), F.lit(False))
    return kept.withColumn("flagged", flagged).withColumn("importance", new).drop("_new")


def without_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose ends are still there."""
    ids = entities.select("id")
    return relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def roll_up_signals(signals: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """``signals(bonus_type, signal, delta, at)`` to counts and sums a month, bonus type and signal, and the raw rows of the last days.

    All signals count, those purged too, so a roll-up is taken before its purge.
    """
    months = signals.groupBy(F.date_trunc("month", "at").alias("month"), "bonus_type", "signal").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"))
    return months, signals.where(F.datediff(today, "at") <= SIGNAL_DAYS)


def daily_sketches(calls: DataFrame, k: int = 400) -> DataFrame:
    """``calls(tool, at, elapsed_ms, hit)`` to a row a tool and day: calls, hits and a mergeable quantile sketch of ``k``."""
    return calls.groupBy("tool", F.to_date("at").alias("day")).agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"), F.kll_sketch_agg_double(F.col("elapsed_ms").cast("double"), k).alias("sketch"))


def latency_over(days: DataFrame, since: Column, until: Column) -> DataFrame:
    """Daily rows of ``[since, until]`` merged to a row a tool: calls, hit rate, and percentiles within the sketches' rank error."""
    merged = days.where(F.col("day").between(since, until)).groupBy("tool").agg(F.sum("calls").alias("calls"), (F.sum("hits") / F.sum("calls")).alias("hit_rate"), F.kll_merge_agg_double("sketch").alias("s"))
    at = lambda q: F.kll_sketch_get_quantile_double("s", F.lit(q))
    return merged.select("tool", "calls", "hit_rate", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


_KEY = ["qualified_name", "file_path"]


def merge_entities(mine: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two stores' ``(id, qualified_name, file_path, value, authority, confidence)`` as one, and ``(their_id, id)``.

    An entity is its qualified name and file, nulls being equal. One that both hold keeps
    our id (the smallest where several rows hold it); its value is settled as conflicts
    are, and stays ours where that leaves it open. New ones are numbered on from our
    greatest id in key order, so importing a store again changes nothing.
    """
    ours = stored(mine.select("id", *_KEY, "value", "authority", "confidence"), "mine")
    top = ours.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    folded = theirs.groupBy(*_KEY).agg(F.min_by(F.struct("value", "authority", "confidence"), "id").alias("v"))
    first = ours.groupBy(*_KEY).agg(F.min("id").alias("id"))
    same = lambda a, b: F.col(f"{a}.qualified_name").eqNullSafe(F.col(f"{b}.qualified_name")) & F.col(f"{a}.file_path").eqNullSafe(F.col(f"{b}.file_path"))
    met = stored(folded.alias("t").join(first.alias("m"), same("t", "m"), "left").select("t.qualified_name", "t.file_path", "t.v", "m.id"), "met")
    new = numbered(met.where("id IS NULL").drop("id"), [F.asc_nulls_first("qualified_name"), F.asc_nulls_first("file_path")], "n")
    new = new.select((F.col("n") + top).alias("id"), *_KEY, "v.value", "v.authority", "v.confidence")
    both = ours.join(met.where("id IS NOT NULL").select("id", F.col("v").alias("t")), "id")
    side = lambda pos, c: F.struct(F.lit(pos).alias("pos"), *[c(x).alias(x) for x in ("value", "authority", "confidence")])
    candidates = both.select(F.col("id").alias("key"), F.explode(F.array(side(0, F.col), side(1, lambda x: F.col(f"t.{x}")))).alias("c")).select("key", "c.*")
    settled = resolve_conflicts(candidates).where("resolved").select(F.col("key").alias("id"), F.struct("value", "authority", "confidence").alias("s"))
    kept = ours.join(settled, "id", "left")
    kept = kept.select("id", *_KEY, *[F.when(F.col("s").isNotNull(), F.col(f"s.{x}")).otherwise(F.col(x)).alias(x) for x in ("value", "authority", "confidence")])
    out = stored(kept.unionByName(new), "merged")
    ids = out.groupBy(*_KEY).agg(F.min("id").alias("id"))
    named = theirs.select(F.col("id").alias("their_id"), *_KEY).alias("t").join(ids.alias("m"), same("t", "m")).select("their_id", "m.id")
    return out, named


def merge_relations(mine: DataFrame, theirs: DataFrame, ids: DataFrame) -> DataFrame:
    """Our ``(id, source_id, target_id, kind)`` with theirs between the merged entities ``ids(their_id, id)``, each edge once.

    Edges of theirs to entities that the import doesn't hold are dropped; new ones are
    numbered on from our greatest id.
    """
    top = mine.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    end = lambda c: ids.select(F.col("their_id").alias(c), F.col("id").alias(f"_{c}"))
    moved = theirs.join(end("source_id"), "source_id").join(end("target_id"), "target_id")
    moved = moved.select(F.col("_source_id").alias("source_id"), F.col("_target_id").alias("target_id"), "kind").distinct()
    new = moved.join(mine, ["source_id", "target_id", "kind"], "left_anti")
    new = numbered(new, ["source_id", "target_id", "kind"], "n")
    return mine.select("id", "source_id", "target_id", "kind").unionByName(new.select((F.col("n") + top).alias("id"), "source_id", "target_id", "kind"))


def propagate(values: DataFrame, edges: DataFrame, changed: DataFrame, combine: Callable[[Column], Column], levels: int) -> DataFrame:
    """New values after ``changed(node, value)``, recomputing along ``edges(source, target, level)`` only behind values that differ.

    ``values(node, value)`` holds all nodes' values, level 0 being inputs; a node of a
    level has sources of lower levels only, and its value is the aggregate ``combine`` of
    theirs. A node is recomputed if a source's value changed, and what it feeds only if its
    own did. Gives ``(node, level, old, value)`` for each input that changed and each node
    that was recomputed, equal values included.
    """
    was = values.select("node", F.col("value").alias("old"))
    done = stored(changed.join(was, "node").where(~F.col("value").eqNullSafe(F.col("old"))).select("node", F.lit(0).alias("level"), "old", "value"), "level")
    rounds = [done]
    moved = done
    for level in range(1, levels + 1):
        own = edges.where(F.col("level") == level)
        moved_now = moved.where(~F.col("value").eqNullSafe(F.col("old"))).select(F.col("node").alias("source"), F.col("value").alias("_new"), F.lit(True).alias("_moved"))
        hit = own.join(moved_now.select("source"), "source", "left_semi").select("target").distinct()
        inputs = own.join(hit, "target", "left_semi").join(values.select(F.col("node").alias("source"), "value"), "source").join(moved_now, "source", "left")
        now = inputs.withColumn("value", F.when(F.col("_moved"), F.col("_new")).otherwise(F.col("value")))
        done = now.groupBy(F.col("target").alias("node")).agg(combine(F.col("value")).alias("value")).join(was, "node")
        done = stored(done.select("node", F.lit(level).alias("level"), "old", "value"), "level")
        rounds.append(done)
        moved = stored(moved.unionByName(done), "moved") if level < levels else moved
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``path`` of ``paths`` that ignore files exclude: ``rules(folder, pos, pattern)``, '' being the root's file.

    A rule reaches what lies below its folder. For each folder and file on a path the
    deepest ignore file decides, in it the last pattern that fits; ``!`` takes a file back,
    but nothing below an excluded folder comes back. Rules meet paths by folder, so the
    cost follows the paths' depth, not the number of rules.
    """
    p = F.rtrim("pattern")
    plain = F.regexp_replace(p, "^!", "")
    stem = F.rtrim(plain, F.lit("/"))
    anchored = F.contains(stem, F.lit("/"))
    body = F.regexp_replace(F.ltrim(stem, F.lit("/")), r"([.+^$(){}|\[\]\\])", r"\\$1")
    # a marked ** first, so that its stars aren't taken for single ones
    body = F.regexp_replace(F.regexp_replace(body, r"\*\*/", "\u0001"), r"\*\*", "\u0002")
    body = F.regexp_replace(F.regexp_replace(body, r"\*", "[^/]*"), r"\?", "[^/]")
    body = F.replace(F.replace(body, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    known = rules.where((p != "") & ~F.startswith(p, F.lit("#")))
    known = known.select(
        "folder", "pos", F.startswith(p, F.lit("!")).alias("keep"), F.endswith(plain, F.lit("/")).alias("only_folders"),
        F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), body, F.lit("$")).alias("rx"),
    )
    parts = F.split("path", "/")
    heads = paths.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("d", "head"))
    heads = heads.select("path", "head", (F.col("head") != F.col("path")).alias("is_folder")).select("head", "is_folder").distinct()
    above = F.split("head", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(above) - 1), lambda k: F.array_join(F.slice(above, 1, k), "/"))
    met = heads.select("head", "is_folder", F.posexplode(folders).alias("depth", "folder")).join(known, "folder")
    rest = F.when(F.col("folder") == "", F.col("head")).otherwise(F.substr("head", F.length("folder") + 2))
    met = met.withColumn("rest", rest).where(F.expr("rest RLIKE rx") & (F.col("is_folder") | ~F.col("only_folders")))
    gone = met.groupBy("head", "is_folder").agg(F.max_by("keep", F.struct("depth", "pos")).alias("keep")).where("NOT keep").select("head", "is_folder")
    on = paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("head"))
    on = on.withColumn("is_folder", F.col("head") != F.col("path"))
    return on.join(gone, ["head", "is_folder"], "left_semi").select("path").distinct()
