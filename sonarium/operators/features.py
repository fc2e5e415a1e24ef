"""Spectral features per recording, and resampling, as Arrow-batched jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.functions import pcm as kernels
from sonarium.schemas import HOP_LENGTH, N_FFT, N_MFCC, SAMPLE_RATE

#: Samples or features that a Python worker hands over at once, and their rows, whatever an Arrow batch holds.
FRAME_BYTES = 4 << 20
FRAME_ROWS = 500
MATRIX = T.ArrayType(T.ArrayType(T.FloatType()))
MATRIX64 = T.ArrayType(T.ArrayType(T.DoubleType()))


def _per_row(df: DataFrame, samples: str, name: str, kind: T.DataType, make) -> DataFrame:
    """Replace the sample column by ``make(samples, rate)``, some rows of an Arrow batch at a time."""
    schema = T.StructType([f for f in df.schema.fields if f.name != samples] + [T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            others, begun, values, held = batch.drop(columns=[samples]), 0, [], 0
            for at, (s, r) in enumerate(zip(batch[samples], batch["rate"]), 1):
                made = make(np.asarray(s, dtype=np.float64), r)
                values.append(made)
                held += sum(row.nbytes for row in made) if isinstance(made, list) else made.nbytes
                if held >= FRAME_BYTES or len(values) >= FRAME_ROWS or at == len(batch):
                    part = others.iloc[begun:at]
                    yield part.assign(**{name: pd.Series(values, index=part.index, dtype=object)})
                    begun, values, held = at, [], 0

    return df.mapInPandas(run, schema)


def mfcc(
    audio: DataFrame, n_mfcc: int = N_MFCC, n_fft: int = N_FFT, hop: int = HOP_LENGTH,
    n_mels: int = kernels.N_MELS, samples: str = "samples", deltas: bool = False, double: bool = False,
) -> DataFrame:
    """``mfcc_features`` (coefficients x frames) of whole recordings with a ``rate`` column.

    The decibel floor is relative to the loudest cell of the recording, so a recording is one unit of
    work; parallelism is over recordings. ``deltas`` stacks first and second derivatives below.
    """
    if n_fft <= 0 or hop <= 0 or n_mfcc <= 0:
        raise ValueError("n_fft, hop and n_mfcc must be positive")

    def make(values: np.ndarray, rate: int) -> list:
        features = kernels.mfcc(values, int(rate), n_mfcc, n_fft, hop, n_mels)
        if deltas:
            features = np.vstack([features, kernels.delta(features, 1), kernels.delta(features, 2)])
        return list(features if double else features.astype(np.float32))

    return _per_row(audio, samples, "mfcc_features", MATRIX64 if double else MATRIX, make)


def spectral_features(audio: DataFrame, n_fft: int = N_FFT, hop: int = HOP_LENGTH, samples: str = "samples") -> DataFrame:
    """``spectral_features``: centroid, bandwidth and rolloff rows per frame."""
    if n_fft <= 0 or hop <= 0:
        raise ValueError("n_fft and hop must be positive")
    return _per_row(
        audio, samples, "spectral_features", MATRIX64,
        lambda values, rate: list(kernels.spectral_shape(values, int(rate), n_fft, hop)),
    )


def power_spectrum(audio: DataFrame, n_fft: int, hop: int, samples: str = "samples") -> DataFrame:
    """``power``: bins x frames of the squared short-time spectrum."""
    return _per_row(
        audio, samples, "power", MATRIX64, lambda values, rate: list(kernels.power_frames(values, n_fft, hop))
    )


def resample(audio: DataFrame, rate: int = SAMPLE_RATE, samples: str = "samples") -> DataFrame:
    """Bring every recording to ``rate``; recordings already there pass through."""
    resampled = _per_row(
        audio, samples, samples, T.ArrayType(T.DoubleType()),
        lambda values, source: kernels.resample(values, int(source), rate),
    )
    return resampled.withColumn("rate", F.lit(rate)).withColumn("frames", F.size(samples).cast("bigint"))


def room_response(audio: DataFrame, response: list[float], samples: str = "samples") -> DataFrame:
    """Recordings convolved with one room impulse response."""
    impulse = np.asarray(response, dtype=np.float64)
    return _per_row(
        audio, samples, samples, T.ArrayType(T.DoubleType()), lambda values, rate: kernels.convolve(values, impulse)
    )


@F.pandas_udf(T.ArrayType(T.ShortType()))
def decode_pcm16(buffers: pd.Series) -> pd.Series:
    return buffers.map(kernels.decode)


@F.pandas_udf(T.BinaryType())
def encode_pcm16(samples: pd.Series) -> pd.Series:
    return samples.map(kernels.encode)


@F.pandas_udf(T.BinaryType())
def wav_bytes(pcm: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([kernels.write_wav(p, int(r)) for p, r in zip(pcm, rate)], index=pcm.index, dtype=object)


def frame_column(samples: Column, n: int) -> Column:
    """Cut an array into consecutive runs of ``n`` (the last may be shorter)."""
    starts = F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / n).cast("int"))
    return F.transform(starts, lambda i: F.slice(samples, i * n + 1, F.lit(n)))
