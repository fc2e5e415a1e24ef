"""Sinks: tables, metrics, features, WAV files, copies and detection events."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.operators.features import wav_bytes
from sonarium.operators.lookups import assemble_clips, clip_range
from sonarium.schemas import SAMPLE_RATE
from sonarium.sources import folders

def write_annotations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_metrics_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """For the one-row metric tables only."""
    df.coalesce(1).write.mode(mode).json(path, ignoreNullFields=False)


def write_features(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def _published(rows: DataFrame, folder: str) -> str:
    """``written``, or what the file system had against it; other errors are raised."""
    try:
        folders.publish(rows, folder)
    except PySparkException as problem:
        lines = [x.strip() for x in str(problem).splitlines() if "[Errno" in x or "OSError" in x]
        if not lines:
            raise
        return f"failed: {lines[-1]}"
    return "written"


def write_wav(df: DataFrame, folder: str, name: str = "audio_file_name", pcm: str = "pcm", rate: int = SAMPLE_RATE) -> DataFrame:
    """Write one WAV per row into a folder or URI; returns ``path, frames, status`` of the files, which are there by then.

    They appear together when all are written: a failed or repeated task leaves nothing visible, and if the file system
    refuses them, that is the status of all. Names must differ.
    """
    status = _published(df.select(F.col(name).alias("name"), wav_bytes(F.col(pcm), F.lit(rate)).alias("content")), folder)
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col(name))
    return df.select(path.alias("path"), F.floor(F.octet_length(pcm) / 2).cast("bigint").alias("frames"), F.lit(status).alias("status"))


def sink_wavs(df: DataFrame, folder: str, log_path: str, **options) -> None:
    """Write the WAVs and keep the write log as a table."""
    write_wav(df, folder, **options).write.mode("append").parquet(log_path)


def copy_missing(plan: DataFrame, files: DataFrame, folder: str, name: str = "audio_file_name") -> DataFrame:
    """Copy the ``fetch`` rows of a sync plan: ``files`` is a ``path, content`` scan of the remote folder.

    Returns ``path, bytes, status`` of the copies, which appear together.
    """
    wanted = plan.filter(F.col("action") == "fetch").select(name).distinct()
    named = files.withColumn(name, F.element_at(F.split("path", "/"), -1)).join(wanted, name, "left_semi")
    status = _published(named.select(F.col(name).alias("name"), "content"), folder)
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col(name))
    return named.select(path.alias("path"), F.octet_length("content").cast("bigint").alias("bytes"), F.lit(status).alias("status"))


def detection_events(detections: DataFrame) -> DataFrame:
    """``key, value`` rows for a topic: the device and a JSON body with an ISO-8601 time.

    Takes detections with ``ts``, or ``ts_ms`` as the stream detector emits it.
    """
    at = F.col("ts") if "ts" in detections.columns else F.timestamp_millis("ts_ms")
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.to_json(F.struct(F.col("device_id"), F.col("seq"), F.col("score"), F.col("source"), stamp.alias("detected_at")))
    return detections.select(F.col("device_id").cast("string").alias("key"), body.alias("value"))


def emit_detections(detections: DataFrame, checkpoint: str, sink: str = "kafka", **options: str):
    """Start publishing a detection stream; ``options`` are the sink's own (servers and topic, or a path)."""
    writer = detection_events(detections).writeStream.format(sink).option("checkpointLocation", checkpoint)
    return writer.options(**options).outputMode("append").start()


def clip_audio(found: DataFrame, chunks: DataFrame, width: int = 64) -> DataFrame:
    """``audio_file_name, pcm`` of the clips that detections name by ``clip_from..clip_to``.

    ``chunks`` is the stored chunk table; a clip has a fixed number of chunks, so its bytes are bounded.
    """
    named = found.filter(F.col("clip_from").isNotNull()).select(
        "device_id", F.col("seq").alias("trigger_seq"), "clip_from", "clip_to"
    )
    context = clip_range(named, chunks.select("device_id", "seq", "pcm"), F.col("clip_from"), F.col("clip_to"), width)
    clips = assemble_clips(context)
    joined = F.aggregate("frames", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))
    name = F.concat_ws("_", F.lit("clip"), F.col("device_id").cast("string"), F.col("trigger_seq").cast("string"))
    return clips.select(F.concat(name, F.lit(".wav")).alias("audio_file_name"), joined.alias("pcm"))


def save_clips(found: DataFrame, chunks: DataFrame, folder: str, log_path: str) -> None:
    """Write the clips of one batch of detections; use it in ``foreachBatch``. Rewriting is harmless."""
    sink_wavs(clip_audio(found, chunks), folder, log_path)
