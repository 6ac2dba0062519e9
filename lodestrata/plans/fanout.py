"""Sources as plugins: a registry of row producers, and their fan-out into one plan.

A source is a callable ``(spark, query) -> DataFrame``. Building a plan is lazy, so
fanning out costs nothing until rows are asked for; sources that fail while planning are
recorded and left out, and those that weigh nothing are never built.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import dims
from lodestrata.operators import fusion

Source = Callable[[SparkSession, dict], DataFrame]
STATUS = "source_id string, grp string, status string, elapsed_ms bigint, error string"


@dataclass
class Registry:
    """Sources by name, each in a group; disabled ones are kept but not asked."""

    sources: dict[str, tuple[str, Source]] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def install(self, name: str, group: str, source: Source) -> None:
        if name in self.sources:
            raise ValueError(f"{name} is installed already")
        self.sources[name] = (group, source)

    def uninstall(self, name: str) -> None:
        del self.sources[name]
        self.disabled.discard(name)

    def enable(self, name: str, on: bool = True) -> None:
        if name not in self.sources:
            raise KeyError(name)
        (self.disabled.discard if on else self.disabled.add)(name)

    def names(self) -> list[str]:
        return sorted(self.sources)


def fan_out(spark: SparkSession, registry: Registry, query: dict, groups: set[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """All sources' rows in one union with ``source_id`` and ``grp``, and the status of each source."""
    rows, status = None, []
    for name, (group, source) in sorted(registry.sources.items()):
        if name in registry.disabled or groups is not None and group not in groups:
            continue
        began = time.monotonic()
        try:
            part = source(spark, query).withColumns({"source_id": F.lit(name), "grp": F.lit(group)})
            part.schema  # a plan that doesn't resolve fails here
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            outcome = ("available", None)
        except Exception as e:  # a source's failure is a status, not the query's failure
            outcome = ("errored", f"{type(e).__name__}: {e}"[:500])
        status.append((name, group, outcome[0], int(1000 * (time.monotonic() - began)), outcome[1]))
    return rows, spark.createDataFrame(status, STATUS)


def fused_query(spark: SparkSession, registry: Registry, query_type: str, query: dict) -> tuple[DataFrame | None, DataFrame]:
    """Cross-group fusion of the sources whose groups weigh something for the query's type."""
    weights = dict(zip(dims.GROUPS, dims.GROUP_WEIGHTS[query_type], strict=True))
    rows, status = fan_out(spark, registry, query, {g for g, w in weights.items() if w})
    return (None if rows is None else fusion.fuse_cross_group(rows.withColumn("status", F.lit("available")), query_type)), status


def run_with_retries(action: Callable[[], DataFrame], tries: int = 3, base_seconds: float = 0.1, sleep: Callable[[float], None] = time.sleep):
    """The action's result, or its last error after ``tries`` attempts with doubling pauses."""
    for k in range(tries):
        try:
            return action()
        except Exception:
            if k + 1 == tries:
                raise
            sleep(base_seconds * 2**k)
