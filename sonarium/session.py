"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Spark deletes the shuffle files of a statement when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "sonarium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The device state of streams has several parts, which only this provider keeps.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rows carry sample arrays: small Arrow batches keep Python workers lean.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` for streams and written tables.

    Only a local session may fall back to a temporary folder; a cluster must name shared storage.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """What is run inside leaves no shuffle files when it ends, where else they stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df, name: str):
    """Write a frame that several jobs reuse to the work folder and read it back (cuts the lineage)."""
    path = work_dir(df.sparkSession, name)
    with tidy_shuffles(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames) -> None:
    """Delete the files of written frames that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
