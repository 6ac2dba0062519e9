"""Upserts, resolution and retention as next snapshots, and versioned table folders.

Parquet has no MERGE: each function returns the next state of a table, and ``commit``
writes it as a new version whose pointer is swapped last, so a failed or repeated job
leaves the old version readable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTITY_KEY = ("qualified_name", "file_path", "t_valid_from")
_ISSUE_KEY = ("file_path", "line_start", "category", "severity", "message")


def upsert_entities(current: DataFrame, incoming: DataFrame, now, refresh: bool = False) -> DataFrame:
    """Known (qualified_name, file_path, t_valid_from) rows are touched, others appended.

    A touch sets ``t_last_verified`` and adds one to ``access_count`` per incoming row; the
    rest of the row stays unless ``refresh``. A null in the key never matches, so such
    rows are always appended. Among new rows with one key the first by id enters.
    """
    has_key = F.lit(True)
    for k in _ENTITY_KEY:
        has_key = has_key & F.col(k).isNotNull()
    keyed, bare = incoming.where(has_key), incoming.where(~has_key)
    touched = keyed.groupBy(*_ENTITY_KEY).agg(F.count("*").alias("_n"), F.min_by(F.struct(*incoming.columns), F.col("id")).alias("_new"))
    c = current.select(*current.columns, F.lit(True).alias("_old"))
    both = c.join(touched, list(_ENTITY_KEY), "full_outer")
    old, touch = F.col("_old").isNotNull(), F.col("_n").isNotNull()
    kept = ("id", *_ENTITY_KEY, "t_ingested_at", "t_valid_to", "importance")
    columns = []
    for name in current.columns:
        value = F.when(old, F.col(name)).otherwise(F.col(f"_new.{name}"))
        if name == "t_last_verified":
            value = F.when(touch, F.lit(now)).otherwise(F.col(name))
        elif name == "access_count":
            value = F.when(old, F.col(name) + F.coalesce("_n", F.lit(0))).otherwise(F.col("_n") - 1 + F.col("_new.access_count"))
        elif refresh and name not in kept:
            value = F.when(touch, F.col(f"_new.{name}")).otherwise(F.col(name))
        columns.append(value.alias(name))
    return both.select(*columns).unionByName(bare.select(*current.columns))


def merge_diagnostics(current: DataFrame, report: DataFrame, reported_files: DataFrame, now) -> DataFrame:
    """The issue table after a report: seen issues touched and reopened, new ones added, the files' others resolved.

    Issues are the same if file, line (null equals null), category, severity and message
    are. A reported file without diagnostics resolves all its issues; files not reported
    stay as they are.
    """
    new = report.dropDuplicates(list(_ISSUE_KEY)).withColumn("_new", F.lit(True))
    files = reported_files.select(F.col("file_path").alias("_f")).distinct().withColumn("_reported", F.lit(True))
    c = current.withColumn("_old", F.lit(True))
    on = F.lit(True)
    for k in _ISSUE_KEY:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = c.alias("c").join(new.alias("n"), on, "full_outer").join(files, F.coalesce("c.file_path", "n.file_path") == F.col("_f"), "left")
    seen, old, reported = F.col("n._new").isNotNull(), F.col("c._old").isNotNull(), F.col("_reported").isNotNull()
    columns = []
    for name in current.columns:
        in_report = name in report.columns
        value = F.when(old, F.col(f"c.{name}")).otherwise(F.col(f"n.{name}") if in_report else F.lit(None))
        if name == "first_seen":
            value = F.when(old, F.col("c.first_seen")).otherwise(F.lit(now))
        elif name == "last_seen":
            value = F.when(seen, F.lit(now)).otherwise(F.col("c.last_seen"))
        elif name == "resolved":
            value = F.when(seen, F.lit(False)).when(reported, F.lit(True)).otherwise(F.col("c.resolved"))
        columns.append(value.alias(name))
    return both.select(*columns)


def purge_resolved(issues: DataFrame, cutoff) -> DataFrame:
    """Without resolved issues last seen strictly before the cutoff; a null time is kept."""
    gone = F.col("resolved") & (F.col("last_seen") < F.lit(cutoff))
    return issues.where(~F.coalesce(gone, F.lit(False)))


def purge_expired(sessions: DataFrame, now) -> DataFrame:
    return sessions.where(~(F.col("expires_at") <= F.lit(now)) | F.col("expires_at").isNull())


def mark_promoted(hot: DataFrame, promoted: DataFrame) -> DataFrame:
    done = promoted.select("id").distinct().withColumn("_done", F.lit(True))
    return hot.join(done, "id", "left").withColumn("promoted", F.col("promoted") | F.coalesce("_done", F.lit(False))).drop("_done")


class VersionedTable:
    """A folder of table versions with a pointer file, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        root = self._path(f"{self.folder}/_pointers")
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root))

    def read(self, schema: str | None = None) -> DataFrame:
        names = self.versions()
        if not names:
            if schema is None:
                raise FileNotFoundError(self.folder)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{names[-1].split('.', 1)[1]}")

    def commit(self, df: DataFrame) -> str:
        """Writes ``df`` as the next version; readers see it once its pointer exists.

        The version's number is taken before the rows are written and claimed after that by
        a file whose creation only one writer can win; another writer of the same version
        gets an error, so that no update is lost.
        """
        number = len(self.versions())
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        for folder in ("_pointers", "_claims"):
            self._fs.mkdirs(self._path(f"{self.folder}/{folder}"))
        claim = self._path(f"{self.folder}/_claims/{number:08d}")
        try:
            won = self._fs.createNewFile(claim)
        except Exception as raced:  # some file systems raise where others answer false
            if not self._fs.exists(claim):
                raise
            raise FileExistsError(str(claim)) from raced
        if not won:
            raise FileExistsError(str(claim))
        self._fs.createNewFile(self._path(f"{self.folder}/_pointers/{number:08d}.{name}"))
        return name

    def fork(self, folder: str) -> "VersionedTable":
        """A new table that starts from this one's newest version."""
        other = VersionedTable(self.spark, folder)
        if not other.versions() and self.versions():
            other.commit(self.read())
        return other

    def archive(self, name: str) -> str:
        """Moves the folder beside its siblings' archive."""
        parent = self.folder.rsplit("/", 1)[0]
        to = f"{parent}/.archive/{name}"
        self._fs.mkdirs(self._path(f"{parent}/.archive"))
        self._fs.rename(self._path(self.folder), self._path(to))
        return to


def check_version(stored: int | None, own: int) -> int:
    """The version to stamp; a table written by a newer program is refused."""
    if stored is not None and stored > own:
        raise ValueError(f"the table has version {stored}, this program knows {own}")
    return own


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with the new rows after it; their ids go on from the largest, in the order of their columns."""
    from lodestrata.operators.graph import numbered

    first = log.agg(F.max("id")).first()[0] or 0
    added = numbered(new, [F.asc(c) for c in new.columns], "id").withColumn("id", F.col("id") + first)
    return log.unionByName(added.select(*log.columns))


def upsert_relations(current: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Relations ``(id, source_id, target_id, kind, weight, t_last_verified)``, one a (source, target, kind).

    A known edge keeps its id and takes the greatest incoming weight and the time; of new
    rows with one key the first by id enters with that weight. A null end or kind never
    matches, so such rows are appended.
    """
    key = ["source_id", "target_id", "kind"]
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("kind").isNotNull()
    keyed, bare = incoming.where(whole), incoming.where(~whole)
    new = keyed.groupBy(*key).agg(F.min("id").alias("_id"), F.max("weight").alias("_weight"), F.lit(True).alias("_new"))
    both = current.join(new, key, "full_outer")
    known, seen = F.col("id").isNotNull(), F.col("_new").isNotNull()
    weight = F.when(known & seen, F.greatest("weight", "_weight")).when(known, F.col("weight")).otherwise(F.col("_weight"))
    at = F.when(seen, F.lit(now)).otherwise(F.col("t_last_verified"))
    out = both.select(F.coalesce("id", "_id").alias("id"), *key, weight.alias("weight"), at.alias("t_last_verified"))
    return out.unionByName(bare.select("id", *key, "weight", F.lit(now).alias("t_last_verified")))


def insert_conventions(current: DataFrame, new: DataFrame, now) -> DataFrame:
    """Conventions ``(id, category, pattern, confidence, t_ingested_at)`` with the new ``(category, pattern, confidence)`` after them.

    Inserting is an append: a pattern that is there already becomes one more row.
    """
    return appended(current, new.select("category", "pattern", "confidence", F.lit(now).alias("t_ingested_at")))


def next_batch(rows: DataFrame, n: int = 256) -> DataFrame:
    """The ``n`` oldest rows that aren't promoted yet, by id."""
    return rows.where(~F.coalesce("promoted", F.lit(False))).orderBy("id").limit(n)
