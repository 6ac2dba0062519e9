"""Traversals and ranking over edge tables, level by level.

Each level is one join of the frontier with the edges; levels are cut with
stored tables so plans don't grow. The only values that reach the driver are
a level's row count and a rank round's change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stored


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the cluster's shared folder, its lineage dropped."""
    return stored(df, "level")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in a total order, without gathering them in one task.

    The rows are range-sorted once and kept; a row's number is its place in its partition
    plus the sizes of the partitions before, a table with a row a partition.
    """
    at = F.monotonically_increasing_id()
    kept = cut(df.orderBy(*order).withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    out = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + place + 1).drop("_part", "_start", "_at")


def directional_bfs(edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """``(node, depth)`` of nodes reached from ``seeds(node)`` within ``max_depth``, seeds excluded, at least depth."""
    near, far = ("target", "source") if direction == "upstream" else ("source", "target")
    links = edges.select(F.col(near).alias("node"), F.col(far).alias("next")).where("node <> next").distinct()
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(links, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.where("depth > 0")


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Undirected multi-seed search over merged edges ``(source, target, edge_kind, coupling, pos)``.

    Returns ``(node, depth, weight, parent, via, path)``. A node belongs to the parent that
    a queue would reach it from first: parents in queue order, then their edges in merged
    order (source, target, then position). Weight is the product of couplings along that
    chain. ``seeds(node, pos)`` have depth 0 and weight 1 even if no edge touches them.
    """
    ranked = edges.select("source", "target", "edge_kind", "coupling", F.struct("source", "target", "pos").alias("adj"))
    both = ranked.select(F.col("source").alias("parent"), F.col("target").alias("node"), "coupling", "adj", "edge_kind").unionByName(
        ranked.select(F.col("target").alias("parent"), F.col("source").alias("node"), "coupling", "adj", "edge_kind")
    )
    links = cut(both.where("parent <> node"))
    start = seeds.groupBy("node").agg(F.min("pos").alias("pos"))
    start = numbered(start, [F.asc("pos"), F.asc("node")], "qpos")
    seen = cut(start.select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via"), "qpos", F.array(F.col("node").cast("string")).alias("path")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reach = frontier.select(F.col("node").alias("parent"), "qpos", "weight", "path").join(links, "parent").join(seen.select("node"), "node", "left_anti")
        row = F.struct("qpos", "adj", "parent", "weight", "coupling", "edge_kind", "path")
        first = reach.groupBy("node").agg(F.min(row).alias("r"))
        queue = [F.asc("r.qpos"), F.asc("r.adj"), F.asc("node")]  # the order in which a queue would hold this level
        nxt = numbered(first, queue, "qpos").select(
            "node", F.lit(depth).alias("depth"), (F.col("r.weight") * F.col("r.coupling")).alias("weight"), F.col("r.parent").cast("string").alias("parent"),
            F.col("r.edge_kind").alias("via"), "qpos", F.concat(F.col("r.path"), F.array(F.col("node").cast("string"))).alias("path"),
        )
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.drop("qpos")


def impacted(reached: DataFrame) -> DataFrame:
    """What a blast radius reaches besides its seeds, strongest first."""
    return reached.where("depth > 0").orderBy(F.desc("weight"), "depth", "node")


def dependency_chains(reached: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` strongest impacted nodes with their chains back to a seed."""
    top = impacted(reached).limit(n)
    return top.select("node", "depth", F.array_join(F.reverse("path"), " -> ").alias("chain"))


def modules(edges: DataFrame) -> DataFrame:
    """Distinct end points."""
    return edges.select(F.col("source").alias("module")).union(edges.select(F.col("target").alias("module"))).distinct()


def personalized_page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """``nodes(node, mass)`` and ``edges(source, target)`` (parallel edges count) to ``(node, rank)``.

    Mass is normalised by its sum, or uniform if that is zero; the rank of dangling nodes
    is spread evenly. Stops when the summed change falls below ``tolerance``.
    """
    nodes = cut(nodes.groupBy("node").agg(F.sum("mass").alias("mass")))
    head = nodes.agg(F.count("*").alias("n"), F.sum("mass").alias("s")).first()
    n, total = head["n"], head["s"] or 0.0
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    p = F.col("mass") / total if total else F.lit(1.0 / n)
    # no table is broadcast, which would send it through the driver in each round
    known = nodes.select("node").hint("shuffle_hash")
    e = edges.where("source <> target").join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    e = e.groupBy("source", "target").agg(F.count("*").alias("k"))
    out = e.groupBy("source").agg(F.sum("k").alias("out"))
    out = out.hint("shuffle_hash")
    e = cut(e.join(out, "source").select("source", "target", (F.col("k") / F.col("out")).alias("share")))
    base = cut(nodes.withColumn("p", p).join(out.withColumnRenamed("source", "node").hint("shuffle_hash"), "node", "left").select("node", "p", F.col("out").isNull().alias("dangling")))
    ranks = base.select("node", "p", "dangling", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
        flow = e.join(ranks.select(F.col("node").alias("source"), "rank").hint("shuffle_hash"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = F.lit(1 - damping) * F.col("p") + F.lit(damping) * F.coalesce("flow", F.lit(0.0)) + F.lit(damping * lost / n)
        nxt = cut(ranks.join(flow.hint("shuffle_hash"), "node", "left").select("node", "p", "dangling", F.col("rank").alias("_was"), new.alias("rank")))
        moved = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("_was")))).first()[0]
        ranks = nxt.drop("_was")
        if moved < tolerance:
            break
    return ranks.select("node", "rank")


def repo_map(entities: DataFrame, relations: DataFrame, recent: DataFrame, budget: int = 8000, boost: float = 50.0) -> DataFrame:
    """Entities by personalised rank over ``calls`` edges, the longest prefix within the token budget.

    Entities of ``recent(file_path)`` have ``boost`` times the mass of others.
    """
    from lodestrata.functions.text import entity_tokens

    mass = entities.join(recent.distinct().withColumn("_r", F.lit(boost)), "file_path", "left").select(F.col("id").alias("node"), F.coalesce("_r", F.lit(1.0)).alias("mass"))
    ranks = personalized_page_rank(mass, relations.where("kind = 'calls'").select(F.col("source_id").alias("source"), F.col("target_id").alias("target")))
    rows = entities.join(ranks.hint("shuffle_hash"), entities["id"] == ranks["node"]).drop("node")
    tokens = entity_tokens(F.col("signature"), F.col("doc_comment"), F.col("qualified_name"), F.col("name"))
    return fit_to_budget(rows.withColumn("tokens", tokens), "tokens", [F.desc("rank"), F.coalesce("qualified_name", "name"), F.asc("id")], budget)


def fit_to_budget(rows: DataFrame, tokens: str, order: list, budget: int) -> DataFrame:
    """The longest prefix whose tokens fit; the first overshoot ends it.

    A row that costs a token or more uses up the budget, so the prefix has at most
    ``budget`` of them besides those that cost nothing, which are counted; only so many are numbered.
    """
    free = rows.where(F.col(tokens) <= 0).count()
    top = rows.orderBy(*order).limit(budget + 1 + free)
    running = F.sum(tokens).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("running", running).where(F.col("running") <= budget)
