"""Streaming twins of the event-driven parts, and their batch forms.

Promotion writes one folder per batch id, so a batch that runs twice replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.functions.text import words
from lodestrata.operators.graph import numbered
from lodestrata.operators.greedy import first_leaders, shared, signatures
from lodestrata.session import stored


def event_kind(kind: Column) -> Column:
    """Raw notifications to created, modified, removed, renamed or other; a rename is a special modification."""
    out = F.lit("other")
    for prefix, name in (("create", "created"), ("modify", "modified"), ("remove", "removed"), ("modify/name", "renamed")):
        out = F.when(F.startswith(kind, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def debounce(events: DataFrame, gap: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of a path's events (closer than ``gap``) as one row with the last kind; works on streams and batches."""
    e = events.withColumn("at", F.col("at").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("at", late)
    out = e.groupBy("path", F.session_window("at", gap).alias("w")).agg(F.max_by("kind", "at").alias("kind"), F.count("*").alias("n"), F.max("at").alias("last_at"))
    return out.select("path", "kind", "n", "last_at")


def with_hooks(watched: DataFrame, hooks: DataFrame) -> DataFrame:
    """Debounced events and hook events, which bypass the debounce."""
    plain = hooks.select("path", "kind", F.lit(1).cast("bigint").alias("n"), F.col("at").cast("timestamp").alias("last_at"))
    return watched.unionByName(plain)


def index_candidates(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin("created", "modified"))


# ---- promotion of hot rows

#: Keys of sets that may have a similar one which are broadcast at most, some 16 MB.
MEETING = 1_000_000


def cluster_observations(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``(id, raw_text, related_symbol, created_at)`` with ``leader``, the id of a cluster's leader.

    In id order (nulls first, then by text) a row joins the first cluster of its symbol
    (null equals null) whose leader's word set is similar enough, else it leads a new one.
    An empty set is similar to none. Rows of a symbol with equal sets share their first
    row's fate, so they are folded first; sets that may have a similar one are decided in
    rounds (``first_leaders``), not a symbol a task. Of the others only hashes leave a task. Every
    row is kept, whatever its id.
    """
    group = F.coalesce(F.concat(F.lit("s"), F.col("related_symbol")), F.lit("n"))
    held = F.sort_array(F.array_distinct(F.coalesce(words(F.col("raw_text")), F.array().cast("array<string>"))))
    marked = rows.withColumn("_group", group).withColumn("_words", held)
    marked = marked.withColumn("_a", F.xxhash64("_group", "_words")).withColumn("_b", F.xxhash64(F.lit(7), "_group", "_words"))
    filled, key, ident = marked.where(F.size("_words") > 0), ["_a", "_b"], F.col("id").cast("bigint")
    keys = signatures(filled.select(F.col("_group").alias("group"), F.col("_words").alias("words"), "_a"), threshold, "_a")
    postings = stored(shared(keys, "_a"), "shared")
    meet = stored(postings.select("_a").distinct(), "meeting")
    near = filled.join(F.broadcast(meet) if meet.limit(MEETING + 1).count() <= MEETING else meet, "_a", "left_semi")
    near = near.groupBy(*key).agg(F.min(F.struct("_group", "id", "raw_text")).alias("first"), F.first("_words").alias("words"))
    near = stored(numbered(near, ["first._group", "first.id", "first.raw_text"], "place").select(*key, "place", F.col("first._group").alias("group"), F.col("first.id").cast("bigint").alias("id"), "words"), "observations")
    led = first_leaders(near.select("group", "place", "words"), threshold, postings=postings.join(near.select("_a", "place"), "_a").select("key", "place"))
    named = near.select(*key, "place").join(led, "place").join(near.select(F.col("place").alias("leader"), F.col("id").alias("_led")), "leader").select(*key, "_led", F.lit(True).alias("_near"))
    # a set that meets no other is led by its first row: a null id comes first
    first = filled.groupBy(*key).agg(F.when(F.count("*") == F.count("id"), F.min(ident)).alias("_first"))
    named = first.join(named, key, "left").select(*key, F.when(F.col("_near"), F.col("_led")).otherwise(F.col("_first")).alias("leader"))
    out = marked.withColumn("_bare", F.size("_words") == 0).drop("_words").join(stored(named, "leaders"), key, "left")
    return out.select(*rows.columns, F.when(F.col("_bare"), ident).otherwise(F.col("leader")).alias("leader"))


def promote_observations(clustered: DataFrame) -> DataFrame:
    """One warm row a cluster: its longest text by bytes (the last in a tie), times, symbols, count."""
    return _warm(clustered, F.col("raw_text"), F.octet_length("raw_text"))


def _warm(clustered: DataFrame, summary: Column, size: Column) -> DataFrame:
    return clustered.groupBy("leader").agg(
        F.max_by(summary, F.struct(size, F.col("id"))).alias("summary"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.to_json(F.array_sort(F.collect_set("related_symbol"))).alias("symbols"),
        F.count("*").alias("n"),
        F.lit(0.6).alias("confidence"),
    )


def promoted_clusters(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``promote_observations`` of the clusters of ``rows``, whose texts are sent once and never sorted.

    Clusters choose by a text's size and hashes; then each text meets the choices of its
    row in a hash join. Only chosen rows that repeat id and text are told apart after that.
    """
    key = ["id", "_t", "_u"]
    texts = rows.withColumn("_t", F.xxhash64("raw_text")).withColumn("_u", F.xxhash64(F.lit(7), "raw_text"))
    led = cluster_observations(texts.withColumn("_size", F.octet_length("raw_text")), threshold).drop("raw_text")
    warm = _warm(led, F.struct(*key), F.col("_size"))
    warm = stored(warm.select("leader", "summary.*", *[c for c in warm.columns if c not in ("leader", "summary")]).withColumnRenamed("id", "_id"), "warm")
    again = stored(texts.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").drop("k"), "repeated")

    def same(x: DataFrame, id_: str, y: DataFrame) -> Column:
        return x[id_].eqNullSafe(y["id"]) & (x["_t"] == y["_t"]) & (x["_u"] == y["_u"])

    def told(some: DataFrame) -> DataFrame:
        some = some.hint("shuffle_hash")
        return texts.join(some, same(some, "_id", texts)).select("leader", F.col("raw_text").alias("summary"), *[c for c in warm.columns if c not in ("leader", "_id", "_t", "_u")])

    if again.isEmpty():
        return told(warm)
    twice = told(warm.join(again, same(warm, "_id", again), "left_semi")).dropDuplicates(["leader"])
    return told(warm.join(again, same(warm, "_id", again), "left_anti")).unionByName(twice)


def promote_conventions(signals: DataFrame, least: int = 3) -> DataFrame:
    found = signals.groupBy("pattern_hash").agg(F.count("*").alias("n"), F.min_by("pattern", "id").alias("pattern"))
    found = found.where(F.col("n") >= least)
    return found.withColumn("description", F.concat(F.lit("Pattern observed in "), F.col("n").cast("string"), F.lit(" files")))


def promote_architecture(deltas: DataFrame) -> DataFrame:
    out = deltas.groupBy("change_type", "file_path").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    return out.withColumn("summary", F.concat("change_type", F.lit(" in "), "file_path", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))


def link_decisions(material: DataFrame) -> DataFrame:
    from lodestrata.functions.text import decision_title

    return material.where("affected_files IS NOT NULL").select("id", decision_title(F.col("title"), F.col("description")).alias("title"), "affected_files")


def promotion(source: DataFrame, promote: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs ``promote`` on each micro-batch into ``folder/batch=<id>``; ``every`` sets a period, else what is there is taken once."""

    def write(batch: DataFrame, number: int) -> None:
        promote(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()


# ---- sessions and life cycles


def session_state(calls: DataFrame, ttl: int, now: int) -> DataFrame:
    """``(session_id, at, file)`` calls folded to a row a session; the end counts from the first call."""
    out = calls.groupBy("session_id").agg(
        F.min("at").alias("created_at"), F.max("at").alias("last_at"), F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files")
    )
    out = out.withColumn("expires_at", F.col("created_at") + ttl)
    return out.withColumn("expired", F.col("expires_at") <= now)


def sessionise(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Numbers a key's sessions: a pause of more than ``gap`` starts the next."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


# The life cycle of a plugin, (state, event) to next state.
STATES = ("discovered", "registered", "loading", "active", "idle", "stopped", "error")
TRANSITIONS = {
    ("discovered", "register"): "registered",
    ("registered", "load"): "loading",
    ("idle", "load"): "loading",
    ("idle", "wake"): "loading",
    ("loading", "activate"): "active",
}
TRANSITIONS |= {(s, "fail"): "error" for s in STATES}
TRANSITIONS |= {(s, "stop"): "stopped" for s in STATES if s != "error"}
# A call wakes an idle plugin and a passed idle time rests an active one; elsewhere they change nothing.
TRANSITIONS |= {(s, "call"): "loading" if s == "idle" else s for s in STATES}
TRANSITIONS |= {(s, "idle"): "idle" if s == "active" else s for s in STATES}


def fold_lifecycle(log: DataFrame) -> DataFrame:
    """``(plugin, at, event)`` to each plugin's state and how many of its events were illegal there.

    A fold over the events in time order with SQL's ``aggregate``; illegal events change nothing.
    Calls and passed idle times are legal in every state.
    """
    steps = F.array_sort(F.collect_list(F.struct("at", "event")))
    table = F.create_map(*[F.lit(x) for (s, e), t in TRANSITIONS.items() for x in (f"{s}|{e}", t)])
    folded = F.aggregate(
        F.col("steps"),
        F.struct(F.lit("discovered").alias("state"), F.lit(0).alias("illegal")),
        lambda a, x: F.struct(
            F.coalesce(F.try_element_at(table, F.concat(a["state"], F.lit("|"), x["event"])), a["state"]).alias("state"),
            (a["illegal"] + F.try_element_at(table, F.concat(a["state"], F.lit("|"), x["event"])).isNull().cast("int")).alias("illegal"),
        ),
    )
    return log.groupBy("plugin").agg(steps.alias("steps")).select("plugin", folded.alias("f"), F.size("steps").alias("events")).select("plugin", "f.state", "f.illegal", "events")


def idle(state: Column, last_call: Column, now: Column, timeout: int) -> Column:
    return (state == "active") & (now - last_call > timeout)


def reapable(last_used: Column, now: Column, grace: int) -> Column:
    """Whether a shared helper has been unused for the grace period, its end included."""
    return now - last_used >= grace


def recent_paths(touched: DataFrame, n: int) -> DataFrame:
    """The ``n`` paths asked for last, one row each."""
    return touched.groupBy("path").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "path").limit(n)


def live_sessions(calls: DataFrame, ttl: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream of ``calls(session_id, at, file)`` to a row per session and change: created_at, last_at, calls, files, expires_at, expired.

    A session ends ``ttl`` after its first call, however busy it is; a timer on event time
    then gives its last row, ``expired``, and drops its state. A later call of the same id
    begins a session anew. Calls behind the watermark are left out. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    span = _milliseconds(ttl)

    class Sessions(StatefulProcessor):
        """The sums as one value, the files as a map's keys, so that a call costs no rewrite of its session's files."""

        def init(self, handle) -> None:
            self.handle = handle
            self.sums = handle.getValueState("sums", "created bigint, last bigint, calls bigint")
            self.files = handle.getMapState("files", "file string", "n bigint")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            import pandas as pd

            now = timerValues.getCurrentWatermarkInMs()
            parts = list(rows)
            at = pd.concat([p["at"] for p in parts]).astype("int64") // 1000 if parts else []
            held = self.sums.get() if self.sums.exists() else None
            created, last, n = held if held else (None, None, 0)
            first = min(at) if created is None else min(created, min(at))
            if created is not None and first != created:
                self.handle.deleteTimer(created // 1000 + span)
            if first != created:
                self.handle.registerTimer(max(first // 1000 + span, now + 1))
            for p in parts:
                for f in p["file"].dropna().unique():
                    self.files.updateValue((f,), (1,))
            sums = (int(first), int(max(at) if last is None else max(last, max(at))), int(n + len(at)))
            self.sums.update(sums)
            yield self.row(key[0], sums, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            if self.sums.exists():
                yield self.row(key[0], self.sums.get(), True)
            self.sums.clear()
            self.files.clear()

        def row(self, session, sums, expired):
            import pandas as pd

            files = ",".join(sorted(f[0] for f in self.files.keys())) if self.files.exists() else ""
            return pd.DataFrame({"session_id": [session], "created_us": [sums[0]], "last_us": [sums[1]], "calls": [sums[2]], "files": [files], "expires_us": [sums[0] + span * 1000], "expired": [expired]})

        def close(self) -> None:
            pass

    told = calls.select("session_id", F.col("at").cast("timestamp").alias("at"), "file").withWatermark("at", late)
    out = told.groupBy("session_id").transformWithStateInPandas(Sessions(), "session_id string, created_us bigint, last_us bigint, calls bigint, files string, expires_us bigint, expired boolean", "Update", "EventTime")
    time = lambda c: F.timestamp_micros(f"{c}_us").alias(f"{c}_at")
    return out.select("session_id", time("created"), time("last"), "calls", "files", time("expires"), "expired")


def _milliseconds(span: str) -> int:
    """The length of a span such as '30 minutes'."""
    number, unit = span.split()
    return int(float(number) * {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def promote_unpromoted(hot: DataFrame, promoted: DataFrame, promote: Callable[[DataFrame], DataFrame], batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """One promotion: the ``batch`` oldest of ``hot`` whose ids ``promoted(id)`` doesn't hold, promoted, and their ids to be marked with them."""
    taken = stored(hot.join(promoted.select("id"), "id", "left_anti").orderBy("id").limit(batch), "promoting")
    return promote(taken), taken.select("id")


def promotion_loop(hot: DataFrame, folder: str, promote: Callable[[DataFrame], DataFrame], batch: int = 256) -> int:
    """Promotes all of ``hot`` into ``folder/warm`` batch by batch, marking rows in ``folder/marks``; the number of batches of this run.

    A batch's rows and marks carry its number; a batch counts once its marks are written,
    which is after its rows, and one that died in between writes the same rows again.
    """
    spark, number = hot.sparkSession, 0
    marks = f"{folder}/marks"
    done = _read_or_empty(spark, marks)
    begin = done.agg(F.max("batch")).first()[0] if "batch" in done.columns else None
    begin = -1 if begin is None else begin
    while True:
        warm, ids = promote_unpromoted(hot, _read_or_empty(spark, marks), promote, batch)
        if ids.isEmpty():
            return number
        begin, number = begin + 1, number + 1
        warm.write.mode("overwrite").parquet(f"{folder}/warm/batch={begin}")
        ids.write.mode("overwrite").parquet(f"{marks}/batch={begin}")


def _read_or_empty(spark, folder: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.parquet(folder)
    return spark.createDataFrame([], "id bigint")
