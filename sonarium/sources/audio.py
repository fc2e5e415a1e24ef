"""Audio sources: WAV folders, WAV headers and zip archives."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions import pcm as kernels
from sonarium.operators.features import FRAME_BYTES, FRAME_ROWS, resample
from sonarium.schemas import AUDIO, AUDIO_INFO, SAMPLE_RATE
from sonarium.sources import folders


def list_files(spark: SparkSession, dirs: Sequence[str] | str, glob: str = "*.wav") -> DataFrame:
    """``path, content`` of the files in the folders (any Hadoop file system)."""
    paths = [dirs] if isinstance(dirs, str) else list(dirs)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content")


def decode_wavs(files: DataFrame, whole_numbers: bool = True) -> DataFrame:
    """Mono samples on the int16 scale at the native rate, from ``path, content``."""

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch["path"], batch["content"]):
                rate, samples = kernels.read_wav(content, whole_numbers)
                rows.append((path, rate, len(samples), samples))
                held += samples.nbytes
                if held >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=AUDIO.names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=AUDIO.names)

    return files.select("path", "content").mapInPandas(run, AUDIO)


def scan_audio(spark: SparkSession, dirs: Sequence[str] | str, glob: str = "*.wav", whole_numbers: bool = True) -> DataFrame:
    return decode_wavs(list_files(spark, dirs, glob), whole_numbers)


def wav_info(files: DataFrame) -> DataFrame:
    """Rate, channels, frames and duration from the header alone.

    For contents that are at hand; of files in folders :func:`audio_info` reads the headers only.
    """

    def run(batches):
        for batch in batches:
            heads = np.array([kernels.wav_header(c) for c in batch["content"]]).reshape(-1, 3)
            yield pd.DataFrame(
                {
                    "path": batch["path"].to_numpy(),
                    "rate": heads[:, 0],
                    "channels": heads[:, 1],
                    "frames": heads[:, 2],
                    "duration_s": heads[:, 2] / np.maximum(heads[:, 0], 1),
                }
            )

    return files.select("path", "content").mapInPandas(run, AUDIO_INFO)


def audio_info(spark: SparkSession, dirs: Sequence[str] | str, glob: str = "*.wav") -> DataFrame:
    """Rate, channels, frames and duration of WAV files; a task reads a few dozen bytes of each."""
    return folders.headers(spark, dirs, glob)


def scan_audio_archive(spark: SparkSession, path: str, names: DataFrame | None = None, partitions: int | None = None,
                       partition_bytes: int = folders.PARTITION_BYTES) -> DataFrame:
    """WAV members of zip archives as ``path, content``; ``names(filename)`` keeps the listed ones.

    Members are dealt to tasks by their sizes in the archive's directory, so one archive may occupy many tasks.
    ``partitions`` deals them out anew.
    """
    members = folders.members(spark, path, ".wav", partition_bytes)
    if partitions:
        members = members.repartition(partitions)
    if names is not None:
        members = members.withColumn("filename", F.element_at(F.split("path", "/"), -1)).join(
            names.select("filename").distinct(), "filename", "left_semi"
        )
    return members.select("path", "content")


def archive_table(spark: SparkSession, path: str, member_suffix: str, schema: str) -> DataFrame:
    """A CSV member of a zip archive (pool metadata) as a table with the given columns."""
    text = folders.members(spark, path, member_suffix).select(
        F.explode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line"), "path"
    )
    header = ",".join(part.split()[0] for part in schema.split(","))
    rows = text.filter((F.col("line") != "") & ~F.col("line").startswith(header))
    return rows.select(F.from_csv("line", schema).alias("r")).select("r.*")


def load_template(spark: SparkSession, path: str, rate: int = SAMPLE_RATE) -> list[float]:
    """One reference WAV as floats in [-1, 1] at ``rate``; a single short recording by definition."""
    audio = resample(scan_audio(spark, path, "*", whole_numbers=False), rate)
    row = audio.select(F.transform("samples", lambda x: (x / 32768.0).cast("float")).alias("t")).first()
    if row is None:
        raise FileNotFoundError(path)
    return row["t"]
