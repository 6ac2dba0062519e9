"""Response assembly: thresholds, budgets, feedback and scoring of context."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import dims
from lodestrata.functions.text import hit_tokens
from lodestrata.operators.keywords import containing
from lodestrata.operators.lookup import session_dedup
from lodestrata.operators.sweep import touched


def above_threshold(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    return rows.where(F.col("score") >= threshold)


def assemble_response(hits: DataFrame, in_context: DataFrame, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``hits(session_id, file_path, snippet, score)`` to the kept rows, and counters per session.

    Rows under the threshold are counted after those already in context are gone.
    """
    fresh = session_dedup(hits, in_context).withColumn("tokens", hit_tokens(F.col("snippet"), F.col("file_path")))
    kept = above_threshold(fresh, threshold)
    good = F.col("score") >= threshold
    counts = fresh.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(good, F.col("tokens"))), F.lit(0)).alias("token_count"), F.count("*").alias("fresh"), F.count_if(~good).alias("filtered")
    )
    totals = hits.groupBy("session_id").agg(F.count("*").alias("total_input"))
    out = totals.join(counts, "session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return kept, out.select("session_id", "total_input", zero("token_count"), (F.col("total_input") - F.coalesce("fresh", F.lit(0))).alias("deduped"), zero("filtered"))


def analyze_feedback(bonuses: DataFrame, call: DataFrame, edits: DataFrame) -> DataFrame:
    """``(session_id, bonus_id, bonus_type, file_path, line_lo, line_hi, keyword)`` to a signal and an importance change.

    ``call(session_id, reason, files)`` is a session's next call, ``edits(session_id,
    file_path, lo, hi, content)`` what it changed. Lines are compared by a sweep over a
    session's file, keywords are found by one pass over each distinct content, so neither
    costs a test per pair.
    """
    key = ["session_id", "bonus_id", "bonus_type"]
    listed = F.array_contains("files", F.col("file_path"))
    told = F.when(F.col("bonus_type") == "pitfall", F.contains(F.lower("reason"), F.lower("keyword"))).when(F.col("bonus_type").isin("related_code", "test"), listed)
    by_call = bonuses.join(call, "session_id", "left").select(*key, F.coalesce(told, F.lit(False)).alias("hit"))
    by_edit = bonuses.where("bonus_type = 'test'").join(edits.select("session_id", "file_path").distinct(), ["session_id", "file_path"], "left_semi").select(*key)
    lines = bonuses.where("bonus_type = 'quality_issue'").select(F.struct(*key).alias("b"), "session_id", "file_path", F.col("line_lo").alias("lo"), F.col("line_hi").alias("hi"))
    by_lines = touched(lines, edits, ["session_id", "file_path"], "b").select("b.*")
    by_file = by_edit.unionByName(by_lines).withColumn("hit", F.lit(True))
    asked = bonuses.where("bonus_type = 'convention'").select(*key, F.lower("keyword").alias("word"))
    texts = edits.select("session_id", F.lower("content").alias("text")).distinct()
    used = containing(texts, asked, ident="session_id").distinct()
    by_word = asked.join(used, ["session_id", "word"], "left_semi").select(*key, F.lit(True).alias("hit"))
    found = by_call.unionByName(by_file).unionByName(by_word).groupBy(*key).agg(F.bool_or("hit").alias("hit"))
    signal, boost = F.lit("ignored"), F.lit(dims.FEEDBACK_DECAY)
    for kind, (name, delta) in dims.FEEDBACK.items():
        now = F.col("hit") & (F.col("bonus_type") == kind)
        signal, boost = F.when(now, F.lit(name)).otherwise(signal), F.when(now, F.lit(delta)).otherwise(boost)
    return found.select("session_id", "bonus_id", "bonus_type", signal.alias("signal"), boost.alias("delta"))


def relevance(domain: Column, entity: Column, proximity: Column, recency: Column) -> Column:
    return 0.3 * domain + 0.4 * entity + 0.2 * proximity + 0.1 * recency


def decay(importance: Column, rate: float, days: Column) -> Column:
    return importance * F.pow(F.lit(rate), days)


def latency_report(calls: DataFrame) -> DataFrame:
    """``(tool, elapsed_ms, hit)`` to exact percentiles and the hit rate."""
    p = lambda q: F.percentile("elapsed_ms", F.lit(q))
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def covering_tests(coverage: DataFrame, changed: DataFrame) -> DataFrame:
    """``coverage(test_path, file_path, lo, hi)`` and ``changed(file_path, lo, hi)`` to tests that run changed lines.

    A row a test: how many changed files it runs, and those in order.
    """
    ran = coverage.select(F.struct("test_path", "file_path").alias("t"), "file_path", "lo", "hi").distinct()
    pairs = touched(ran, changed, ["file_path"], "t").select("t.*")
    return pairs.groupBy("test_path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))


def drop_overlaps(hits: DataFrame, most: float = 0.7) -> DataFrame:
    """Of hits in one file whose line ranges overlap by more than ``most`` (Jaccard) the best-ranked is kept.

    Greedy: in rank order, the smaller range first in a tie, a hit goes if one that is kept
    overlaps it that much. Hits that share file and range are the best of them first, so
    each file's distinct ranges pass one task in order, and a hit is compared with the kept
    ranges near its own start only. Hits without a rank, file or range are kept.
    """
    near = ["file_path", "start_line", "end_line"]
    whole = F.coalesce((F.col("start_line") <= F.col("end_line")) & F.col("file_path").isNotNull() & F.col("rank").isNotNull(), F.lit(False))
    ranged = hits.where(whole)
    best = ranged.groupBy(*near).agg(F.min("rank").alias("rank"))
    dealt = best.select("file_path", F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint"), "rank").repartition("file_path").sortWithinPartitions("file_path", "rank", "start_line", "end_line")
    gone = dealt.mapInArrow(lambda batches: _overlapped(batches, most), "file_path string, start_line bigint, end_line bigint")
    return ranged.join(best, [*near, "rank"], "left_semi").join(gone, near, "left_anti").unionByName(hits.where(~whole))


def _overlapped(batches: Iterator, most: float) -> Iterator:
    import pyarrow as pa

    now, kept, classes = None, {}, math.ceil(math.log2(1 / most))
    for b in batches:
        out = []
        for name, lo, hi in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if name != now:
                now, kept = name, {}
            n = hi - lo + 1
            # Ranges this alike differ by few powers of two in length, and start within n (1 / most - 1) lines.
            level = n.bit_length()
            hit = False
            for size in range(max(0, level - classes), level + classes + 1):
                cell = 1 << size
                reach = int(n * (1 / most - 1)) + 1
                for place in range((lo - reach) // cell, (lo + reach) // cell + 1):
                    for x, y in kept.get((size, place), ()):
                        hit = hit or (min(hi, y) - max(lo, x) + 1) / (max(hi, y) - min(lo, x) + 1) > most
            if hit:
                out.append((name, lo, hi))
            else:
                kept.setdefault((level, lo // (1 << level)), []).append((lo, hi))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file_path", "start_line", "end_line"])
