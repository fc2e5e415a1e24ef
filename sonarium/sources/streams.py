"""Stream sources and the bounded run of a stream into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium import schemas
from sonarium.session import work_dir

IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``files_per_trigger`` bounds what one micro-batch holds."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_chunks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """``device_id, seq, ts, pcm`` chunks in arrival order."""
    return stream_files(spark, path, schemas.CHUNK_STREAM, files_per_trigger=files_per_trigger)


def match_trigger(payload: Column, expected: str | None) -> Column:
    """A message fires if no payload is expected or the trimmed payload equals it."""
    return F.lit(True) if expected is None else F.trim(payload) == F.lit(expected)


def stream_triggers(spark: SparkSession, path: str, expected: str | None = None,
                    files_per_trigger: int | None = None) -> DataFrame:
    """Out-of-band trigger messages that match."""
    rows = stream_files(spark, path, schemas.TRIGGER_STREAM, files_per_trigger=files_per_trigger)
    return rows.filter(match_trigger(F.col("payload"), expected))


@contextmanager
def _idle_batches(spark: SparkSession, on: bool) -> Iterator[None]:
    before = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, str(on).lower())
    try:
        yield
    finally:
        spark.conf.set(IDLE_BATCHES, before)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", close: Callable[[], None] | None = None,
                 idle: bool = True) -> DataFrame:
    """Process everything available, then return the written table.

    ``close`` runs when all is processed; what it adds to the sources is processed in a second run of the same query.
    A row later than all others, added so, passes the watermark over windows that are still open.

    ``idle=False`` runs no batch without data: state that expires by the clock would ask for such batches for ever. Leave
    it on for watermarks, which need one more batch to close what is open.

    Output and checkpoint live below the session's ``spark.checkpoint.dir``. Append results go through
    the exactly-once file sink; ``complete`` results replace the table batch by batch.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = work_dir(spark, name)
    table = f"{base}/table"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    for before in (None, close) if close else (None,):
        if before:
            before()
        with _idle_batches(spark, idle):  # a query keeps what it finds at its start
            if mode == "append":
                query = writer.format("parquet").outputMode("append").start(table)
            else:
                query = writer.outputMode(mode).foreachBatch(
                    lambda batch, number: batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
                ).start()
        query.awaitTermination()
    written = spark.read.schema(stream.schema)
    if mode == "append":
        return written.parquet(table)
    last = query.lastProgress["batchId"]
    return written.parquet(f"{table}/batch={last}")
