"""What a session needs before functions of this package run on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of an Arrow batch, by which long texts bound a batch before its number of rows does.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Puts the package's own folder on the workers' path, where nodes have it at the same place.

    On a cluster whose nodes don't, ship the package with ``--py-files`` or install it.
    Arrow batches are bounded by BATCH_BYTES, unless the cluster's settings name a bound.
    """
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local folder of our own only where none is named (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/lodestrata-shared"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, its lineage cut; removed when the application ends.

    A lost executor costs a re-read, and what reads the table knows its size.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lodestrata/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
