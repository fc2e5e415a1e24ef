"""Recordings in tiles: work on long recordings without a row, or a task, that holds one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.functions import pcm as kernels
from sonarium.schemas import HOP_LENGTH, N_FFT, N_MFCC
from sonarium.session import materialize


def cut_tiles(pieces: DataFrame, key: str, width: int, before: int = 0, after: int = 0, pad: bool = False, start: str = "start",
              samples: str = "samples") -> DataFrame:
    """``key, tile, n, samples``: every recording in tiles of ``width`` samples with some of its neighbours' around.

    ``pieces`` holds runs of samples and where they start in their recording; they may be of any length, and a recording's
    runs must follow each other without gaps. Tile ``i`` has samples ``i * width - before`` to ``(i + 1) * width + after``,
    and ``n`` is the length of the recording. With ``pad`` samples outside of it are zeros, and a recording whose length is
    a multiple of ``width`` has one more tile. Rows meet on ``(key, tile)``, so a long recording spreads over its tiles.
    """
    if width < 1 or before < 0 or after < 0:
        raise ValueError("a tile needs a positive width, and context of at least 0")
    size, at = F.size(samples), F.col(start)
    runs = pieces.where(size > 0)
    length = runs.groupBy(key).agg(F.max(at + size).cast("bigint").alias("n"), F.sum(size).cast("bigint").alias("_held"))
    low = F.greatest(F.floor((at - F.lit(after)) / F.lit(width)), F.lit(0))
    high = F.floor((at + size - 1 + F.lit(before)) / F.lit(width))

    def part(tile):
        """What a run gives to a tile, and where that starts in the recording."""
        first = F.greatest(tile * F.lit(width) - F.lit(before), at)
        stop = F.least((tile + 1) * F.lit(width) + F.lit(after), at + size)
        return F.struct(tile.alias("tile"), first.alias("at"), F.slice(samples, (first - at + 1).cast("int"), F.greatest(stop - first, F.lit(0)).cast("int")).alias("part"))

    # Slices first, then rows: no row carries a run once for each of its tiles.
    parts = runs.select(key, F.explode(F.transform(F.sequence(low.cast("bigint"), high.cast("bigint")), part)).alias("_p")).select(key, "_p.*")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]))
    tiles = parts.where(F.size("part") > 0).groupBy(key, "tile").agg(joined.alias("_joined")).join(length, key)
    end = F.col("n") if pad else F.col("n") - 1
    tiles = tiles.where(F.col("tile") <= F.floor(end / F.lit(width)))
    first, stop = F.col("tile") * F.lit(width) - F.lit(before), (F.col("tile") + 1) * F.lit(width) + F.lit(after)
    expected = F.least(stop, F.col("n")) - F.greatest(first, F.lit(0))
    whole = (F.size("_joined") == expected) & (F.col("_held") == F.col("n"))
    gaps = F.raise_error(F.concat(F.lit("runs with gaps or overlaps in recording "), F.col(key).cast("string")))
    body = F.when(whole, F.col("_joined")).otherwise(gaps.cast(pieces.schema[samples].dataType))
    if pad:
        zero = F.lit(0).cast(pieces.schema[samples].dataType.elementType)
        left, right = F.greatest(-first, F.lit(0)).cast("int"), F.greatest(stop - F.greatest(F.col("n"), first), F.lit(0)).cast("int")
        body = F.concat(F.array_repeat(zero, left), body, F.array_repeat(zero, right))
        # A tile may hold nothing but what lies behind the end, when no context reaches back.
    return tiles.select(key, "tile", "n", body.alias(samples))


def ncc_tiles(pieces: DataFrame, key: str, template: Sequence[float], width: int, scale: float = 1.0) -> DataFrame:
    """Peak normalised correlation of every recording with a template, by overlap-save.

    Tiles overlap by the template less one sample, so every alignment lies in one tile; each is transformed by itself, and
    the recording's score is the largest of its tiles'. A tile may be narrower than the template. Recordings shorter than
    the template and silent ones score 0.0; ``scale`` divides the samples first.
    """
    reference = np.asarray(template, dtype=np.float64)

    @F.pandas_udf(T.DoubleType())
    def score(windows: pd.Series) -> pd.Series:
        return pd.Series(kernels.correlation_peaks([np.asarray(w, np.float64) / scale for w in windows], reference))

    tiles = cut_tiles(pieces, key, width, after=max(0, len(reference) - 1))
    return tiles.groupBy(key).agg(F.max(score("samples")).alias("score"))


def mfcc_tiles(pieces: DataFrame, key: str, rate: int, n_mfcc: int = N_MFCC, n_fft: int = N_FFT, hop: int = HOP_LENGTH,
               n_mels: int = kernels.N_MELS, frames_per_tile: int = 1024) -> DataFrame:
    """``key, frame_no, coefficients``: the cepstral coefficients of every frame, in two passes over tiles of frames.

    The first pass takes each tile to decibels; the recording's loudest cell, a maximum over its tiles, sets the floor of
    the second, which takes the cosine transform. The decibels are written to the work folder in between. Equal to
    ``features.mfcc`` of the whole recording for every ``frames_per_tile``.
    """
    if n_fft <= 0 or hop <= 0 or n_mfcc <= 0 or frames_per_tile <= 0:
        raise ValueError("n_fft, hop, n_mfcc and frames_per_tile must be positive")
    half, width = n_fft // 2, frames_per_tile * hop
    kind = pieces.schema[key].dataType
    cells = T.ArrayType(T.ArrayType(T.DoubleType()))

    def decibels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, tops = [], []
            for tile, n, samples in zip(batch["tile"], batch["n"], batch["samples"]):
                count = min(frames_per_tile, 1 + n // hop - tile * frames_per_tile)
                power = kernels.frame_power(np.asarray(samples, np.float64), n_fft, hop, count)
                db = 10.0 * np.log10(np.maximum(kernels.mel_weights(rate, n_fft, n_mels) @ power, kernels.POWER_FLOOR))
                values.append(list(db.T))
                tops.append(db.max())
            yield batch[[key, "tile"]].assign(db=pd.Series(values, index=batch.index, dtype=object), top=tops)

    def cepstra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            basis = kernels.cosine_basis(n_mfcc, n_mels)
            values = [list((basis @ np.maximum(np.stack(db).T, peak - kernels.TOP_DB)).T) for db, peak in zip(batch["db"], batch["peak"])]
            yield batch[[key, "tile"]].assign(cells=pd.Series(values, index=batch.index, dtype=object))

    named = T.StructType([T.StructField(key, kind), T.StructField("tile", T.LongType())])
    tiles = cut_tiles(pieces, key, width, half, max(0, n_fft - half - hop), pad=True)
    levels = materialize(tiles.mapInPandas(decibels, T.StructType([*named.fields, T.StructField("db", cells), T.StructField("top", T.DoubleType())])), "decibels")
    peaks = levels.groupBy(key).agg(F.max("top").alias("peak"))
    found = levels.join(peaks, key).select(key, "tile", "db", "peak").mapInPandas(cepstra, T.StructType([*named.fields, T.StructField("cells", cells)]))
    return found.select(key, (F.col("tile") * F.lit(frames_per_tile)).alias("_first"), F.posexplode("cells").alias("_i", "coefficients")).select(
        key, (F.col("_first") + F.col("_i")).alias("frame_no"), "coefficients"
    )
