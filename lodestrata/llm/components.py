"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (partially aggregated before the shuffle) joined
back to the edges, so a hub with very many edges is split like any skewed join side
and never gathered in one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.scratch import table


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
    ).first()
    return row["n"], int(row["h"] or 0)


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = _oriented(large)
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    near = large.join(least, "a")
    small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(small.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; label is the component's least node.

    Self-links and null ends are ignored; repeated and reversed links count once.
    An empty edge table gives an empty result.
    """
    kind = edges.schema["a"].dataType
    now = table(_oriented(edges), "links")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        nxt = table(_round(now), "links")
        after = _state(nxt)
        now, state, before = nxt, after, state
        if after == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
    return out.select(F.col("node").cast(kind), F.col("label").cast(kind))
