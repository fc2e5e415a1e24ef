"""Model scores for a chunk stream."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium import schemas
from sonarium.functions.scalars import flatten_features
from sonarium.operators import features
from sonarium.streaming.detector import DetectorSettings, collector_settings, detect_stream


def score_chunks(chunks: DataFrame, model: GBTClassificationModel, n_mfcc: int = schemas.N_MFCC,
                 n_fft: int = schemas.N_FFT, rate: int = schemas.SAMPLE_RATE) -> DataFrame:
    """``device_id, seq, ts, score``: the positive probability of the features of each single chunk.

    Stateless, so a busy device's chunks are scored in parallel before they meet in its state machine.
    A chunk whose features do not fit the model is an error.
    """
    decoded = chunks.select(
        "device_id", "seq", "ts", F.lit(rate).alias("rate"),
        F.transform(features.decode_pcm16("pcm"), lambda x: x.cast("double")).alias("samples"),
    )
    flat = features.mfcc(decoded, n_mfcc, n_fft).withColumn("_flat", flatten_features(F.col("mfcc_features")))
    width = F.size("_flat")
    misfit = F.raise_error(F.concat(F.lit(f"model expects {model.numFeatures} features, got "), width.cast("string")))
    checked = F.when(width == model.numFeatures, F.col("_flat")).otherwise(misfit.cast("array<float>"))
    scored = model.transform(flat.withColumn("features", array_to_vector(checked)))
    return scored.select("device_id", "seq", "ts", vector_to_array("probability")[1].alias("score"))


def model_stream(chunks: DataFrame, model: GBTClassificationModel, triggers: DataFrame | None = None,
                 settings: DetectorSettings | None = None, **feature_options) -> DataFrame:
    """The model detector: warm-up, every third chunk, strict threshold, clips of the surrounding chunks."""
    return detect_stream(score_chunks(chunks, model, **feature_options), settings or collector_settings(), triggers)
