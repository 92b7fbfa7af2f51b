"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "helixframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster leave ``master`` unset and let the submitter decide; the shuffle
    width is then the cluster's too, and adaptive execution resizes it.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings |= {
                "spark.sql.shuffle.partitions": "8",
                "spark.ui.enabled": "false",
            }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine:
    elsewhere executors could not see it, so a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_base()
    return f"{base.rstrip('/')}/helixframe/{purpose}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="helixframe-", dir=os.environ.get("TMPDIR", "/tmp"))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back. Runs a job.

    For a reduced table that is joined to a large one. Its size is then known
    before the join is planned: below ``spark.sql.autoBroadcastJoinThreshold`` it is
    broadcast and the large side is not shuffled, above it the join shuffles both.
    Estimates alone would take the reduced table for as large as its input. The
    written table also survives lost executors. It is deleted by ``release``, or else with the session's JVM.
    """
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    _drop_at_end(df.sparkSession, path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled._settled_path = path
    return settled


def release(*settled: DataFrame | None) -> None:
    """Delete the tables behind results of ``settle`` that nothing will read any more; all else is left alone."""
    for df in settled:
        if path := getattr(df, "_settled_path", None):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _drop_at_end(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the driver's JVM ends, however it ends in good order."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
