"""The batch flow from annotations to the balanced training table, as one composition."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium import schemas
from sonarium.functions.scalars import fill_missing
from sonarium.operators import features, intervals, lookups, sampling
from sonarium.session import materialize
from sonarium.sources.audio import scan_audio


@dataclass(frozen=True)
class TrainingSettings:
    window_ms: int = schemas.WINDOW_MS
    stride_ms: int = schemas.STRIDE_MS
    background_ratio: float = 1.0
    external_ratio: float = 0.5
    seed: int = 42


def stem(path) -> F.Column:
    """File name without folder and suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extract_features(spark: SparkSession, dirs: Sequence[str], n_mfcc: int = schemas.N_MFCC, n_fft: int = schemas.N_FFT,
                     deltas: bool = False) -> DataFrame:
    """``audio_file_name, stem, mfcc_features`` of every WAV in the folders, one flat namespace."""
    audio = scan_audio(spark, dirs).select(
        F.substring_index("path", "/", -1).alias("audio_file_name"), stem("path").alias("stem"), "rate", "samples"
    )
    return features.mfcc(audio, n_mfcc, n_fft, deltas=deltas).drop("rate")


def chunk_table(annotations: DataFrame, info: DataFrame, settings: TrainingSettings = TrainingSettings()) -> DataFrame:
    """Windows of all annotations (real, augmented and pool rows): groups and open ends filled first.

    ``info`` has ``audio_file_name, duration_s, rate, frames``. Windows past the file end are left out.
    """
    if "split_group" not in annotations.columns:
        annotations = annotations.withColumn("split_group", F.lit(None).cast("string"))
    if "noise_pool" not in annotations.columns:
        annotations = annotations.withColumn("noise_pool", F.lit(None).cast("string"))
    grouped = fill_missing(annotations, "split_group", "audio_file_name")
    sized = lookups.attach_duration(grouped, info, keep=("rate", "frames"))
    # windows are derived several times while balancing; the joined intervals only once
    bounded = materialize(intervals.with_bounds(sized), "intervals")
    windows = intervals.index_windows(bounded, settings.window_ms, settings.stride_ms)
    return windows.withColumn("chunk_end", F.col("chunk_start") + settings.window_ms).drop(
        "start_ms", "end_ms", "rate", "frames", "start_sample", "length"
    )


def training_table(annotations: DataFrame, info: DataFrame, feature_table: DataFrame,
                   settings: TrainingSettings = TrainingSettings()) -> DataFrame:
    """Balanced chunks with their feature frames; features are read only for the sampled chunks."""
    chunks = chunk_table(annotations, info, settings)
    keys = ["annotation_id", "file_id", "start", "label", "chunk_start"]
    balanced = sampling.balance(chunks, keys, settings.background_ratio, settings.external_ratio, settings.seed)
    return lookups.attach_features(balanced, feature_table.select("audio_file_name", F.col("mfcc_features").alias("features")))
