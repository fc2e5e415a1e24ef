"""Noise draws and augmentation: mix signal windows with noise windows at target SNRs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.functions import pcm as kernels
from sonarium.functions.keys import md5_key, pick, uniform
from sonarium.functions.scalars import augmented_id, sample_offset
from sonarium.operators.intervals import indexed_count
from sonarium.operators.lookups import attach_samples
from sonarium.schemas import GAIN_JITTER_DB, PAIRS_PER_SIGNAL, SAMPLE_RATE, SNRS_DB

ORDINAL_BLOCK = 1024


def cross_variants(signals: DataFrame, snrs: Sequence[int] = SNRS_DB, pairs: int = PAIRS_PER_SIGNAL) -> DataFrame:
    """Every SNR and pair index for every signal row."""
    return signals.withColumn("snr_db", F.explode(F.array(*[F.lit(int(s)) for s in snrs]))).withColumn(
        "pair_no", F.explode(F.array(*[F.lit(i) for i in range(pairs)]))
    )


def file_offsets(files: DataFrame, pool: str, name: str, count: str) -> DataFrame:
    """Ordinal of the first window of every file inside its pool, ``[_off, _off + count)``.

    Prefix sums run inside ``(pool, digest prefix)`` and over the at most 4,096 prefixes of a pool.
    """
    files = files.withColumn("_p", F.substring(md5_key("offset", F.col(name)), 1, 3))
    buckets = files.groupBy(pool, "_p").agg(F.sum(count).alias("_n"))
    over_buckets = Window.partitionBy(pool).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(pool, "_p", F.coalesce(F.sum("_n").over(over_buckets), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(pool, "_p").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return (
        files.withColumn("_local", F.coalesce(F.sum(count).over(inside), F.lit(0)))
        .join(starts, [pool, "_p"])
        .withColumn("_off", (F.col("_start") + F.col("_local")).cast("bigint"))
        .drop("_p", "_local", "_start")
    )


def draw_noise(
    requests: DataFrame, request_key: str, spans: DataFrame, pools: Sequence[str], size: int, stride: int,
    seed=42, pool: str = "noise_pool", name: str = "path",
) -> DataFrame:
    """Pick a pool uniformly, then a window uniformly in that pool, for every request row.

    ``spans`` are labelled spans or whole files (``pool, path, start_ms, end_ms, rate, frames``). Windows
    are never listed: a span stands for a range of ordinals, ordinals meet spans on ``(pool, block of
    ordinals)``, and the start follows by arithmetic. Adds ``noise_pool, path, start_sample, length``.
    ``pools`` is the configured list; a listed pool without windows is an error.
    """
    counted = spans.withColumn(
        "_n", indexed_count(F.col("start_ms"), F.col("end_ms"), F.col("rate"), F.col("frames"), size, stride)
    ).filter("_n > 0")
    span_id = counted.withColumn("_span", F.concat_ws("@", name, F.col("start_ms").cast("string")))
    placed = file_offsets(span_id, pool, "_span", "_n")
    sizes = counted.groupBy(pool).agg(F.sum("_n").alias("_size"))
    names = F.array(*[F.lit(p) for p in sorted(pools)])
    key = F.col(request_key)
    asked = requests.withColumn(pool, F.element_at(names, (pick(len(pools), seed, F.lit("pool"), key) + 1).cast("int")))
    # one row per configured pool, so this side cannot grow with the data
    listed = sizes.filter(F.col(pool).isin(*pools))
    empty = F.raise_error(F.concat(F.lit("noise pool has no candidate windows: "), F.col(pool))).cast("bigint")
    drawn = (
        asked.join(F.broadcast(listed), pool, "left")
        .withColumn("_ordinal", pick(F.coalesce("_size", empty), seed, F.lit("window"), key))
        .withColumn("_block", F.floor(F.col("_ordinal") / ORDINAL_BLOCK).cast("bigint"))
        .drop("_size")
    )
    first = F.floor(F.col("_off") / ORDINAL_BLOCK).cast("bigint")
    last = F.floor((F.col("_off") + F.col("_n") - 1) / ORDINAL_BLOCK).cast("bigint")
    ranges = placed.select(
        pool, name, "start_ms", "rate", "_off", "_n", F.explode(F.sequence(first, last)).alias("_block")
    )
    inside = (F.col("_ordinal") >= F.col("_off")) & (F.col("_ordinal") < F.col("_off") + F.col("_n"))
    start_ms = F.col("start_ms") + (F.col("_ordinal") - F.col("_off")) * stride
    return (
        drawn.join(ranges, [pool, "_block"])
        .filter(inside)
        .withColumn("start_sample", sample_offset(start_ms, F.col("rate")))
        .withColumn("length", sample_offset(F.lit(size), F.col("rate")))
        .drop("_block", "_ordinal", "_off", "_n", "start_ms", "rate")
    )


def mix_windows(df: DataFrame, signal: str = "window", noise: str = "noise", shift: str = "shift",
                snr: str = "snr_db", gain: str = "gain_db") -> DataFrame:
    """Shift the noise, mix at the SNR, apply the gain: adds ``mixed ARRAY<DOUBLE>``, drops the inputs."""
    kept = [f for f in df.schema.fields if f.name not in (signal, noise)]
    schema = T.StructType(kept + [T.StructField("mixed", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            mixed = [
                kernels.mix(np.asarray(s, dtype=np.float64), np.roll(np.asarray(n, dtype=np.float64), int(k)), d, g)
                for s, n, k, d, g in zip(batch[signal], batch[noise], batch[shift], batch[snr], batch[gain])
            ]
            yield batch.drop(columns=[signal, noise]).assign(mixed=pd.Series(mixed, index=batch.index, dtype=object))

    return df.mapInPandas(run, schema)


def augment(
    signals: DataFrame, spans: DataFrame, audio: DataFrame, pools: Sequence[str], label: str, size: int,
    stride: int, snrs: Sequence[int] = SNRS_DB, pairs: int = PAIRS_PER_SIGNAL,
    gain_jitter_db: float = GAIN_JITTER_DB, seed=42, rate: int = SAMPLE_RATE,
) -> DataFrame:
    """Synthetic positives: every signal window times SNR times pair, mixed with drawn noise.

    ``signals`` holds ``signal_id, window, split_group``; ``audio`` holds the decoded noise recordings at
    ``rate``. The result carries the annotation columns, ``snr_db``, ``noise_pool``, the recording of the
    signal as ``split_group`` and the samples as ``mixed``. Its interval is one millisecond longer than
    the window, which makes :func:`slide_windows` cut exactly one window from it.
    """
    length = int(rate / 1000 * size)
    variants = cross_variants(signals, snrs, pairs).withColumn(
        "sample_id", augmented_id(F.col("snr_db"), F.col("signal_id"), F.col("pair_no"))
    )
    drawn = draw_noise(
        variants.select("sample_id"), "sample_id", spans, pools, size, stride, seed
    )
    noise = attach_samples(drawn, audio, length).select(
        "sample_id", "noise_pool", F.col("path").alias("noise_path"), F.col("window").alias("noise")
    )
    key = F.col("sample_id")
    ready = (
        variants.join(noise, "sample_id")
        .withColumn("shift", pick(length, seed, F.lit("shift"), key))
        .withColumn("gain_db", uniform(-gain_jitter_db, gain_jitter_db, seed, F.lit("gain"), key))
    )
    return mix_windows(ready).select(
        F.col("sample_id").alias("annotation_id"),
        F.col("sample_id").alias("file_id"),
        F.lit(0.0).alias("start"),
        F.lit((size + 1) / 1000).alias("end"),
        F.lit(label).alias("label"),
        F.concat("sample_id", F.lit(".wav")).alias("audio_file_name"),
        F.lit("").alias("remote_audio_path"),
        "snr_db",
        "noise_pool",
        "split_group",
        "mixed",
    )
