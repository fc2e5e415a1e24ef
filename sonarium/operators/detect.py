"""Detection over series and audio chunks: correlation, energy, cooldown, votes, stale devices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.functions import pcm as kernels
from sonarium.functions.signal import correlation_at
from sonarium.operators.cooldown import cooldown
from sonarium.operators.ordered import SEGMENT, overlapping_segments, rolling_energy, rolling_list, squared
from sonarium.schemas import SAMPLE_RATE

INT16_SCALE = 32768.0
FADE_SECONDS = 0.005


def ncc_udf(template: Sequence[float]):
    """``score(pcm)`` of int16 bytes against one template (bounded: at most one chunk long)."""
    reference = np.asarray(template, dtype=np.float32)

    @F.pandas_udf(T.DoubleType())
    def score(buffers: pd.Series) -> pd.Series:
        return pd.Series(kernels.correlation_peaks([kernels.decode(b) / INT16_SCALE for b in buffers], reference))

    return score


def rms_udf():
    """``score(pcm)``: loudness of the window in [0, 1], the template-free trigger."""

    @F.pandas_udf(T.DoubleType())
    def score(buffers: pd.Series) -> pd.Series:
        def loudness(buffer: bytes) -> float:
            audio = kernels.decode(buffer).astype(np.float64) / INT16_SCALE
            return float(np.sqrt(np.mean(audio**2))) if len(audio) else 0.0

        return buffers.map(loudness)

    return score


def multi_template_score(df: DataFrame, pcm: str, templates: dict[str, Sequence[float]]) -> DataFrame:
    """Best score over several templates and the template that gave it."""
    scored = F.array(
        *[F.struct(ncc_udf(wave)(F.col(pcm)).alias("score"), F.lit(name).alias("template")) for name, wave in templates.items()]
    )
    return df.withColumn("_best", F.array_max(scored)).select(
        *df.columns, F.col("_best.score").alias("score"), F.col("_best.template").alias("template")
    )


def ncc_series(df: DataFrame, key: str, order: str, value: str, template: Sequence[float],
               width: int = 4096) -> DataFrame:
    """Peak normalised correlation of every key's series with a short template.

    Alignments are formed inside ``(key, segment)``; the peak per key is a partial aggregate.
    """
    n = len(template)
    aligned = rolling_list(df, [key], order, value, n, "_window", width, ahead=True)
    reference = F.array(*[F.lit(float(x)) for x in template])
    score = F.when(F.size("_window") == n, correlation_at(F.col("_window"), reference)).otherwise(F.lit(0.0))
    return aligned.groupBy(key).agg(F.max(score).alias("score"))


def best_template_series(df: DataFrame, key: str, order: str, value: str, templates: dict[int, Sequence[float]],
                         width: int = 4096) -> DataFrame:
    """Best score over several templates of one length, and the first template that reaches it."""
    n = len(next(iter(templates.values())))
    aligned = rolling_list(df, [key], order, value, n, "_window", width, ahead=True).filter(F.size("_window") == n)
    scores = F.array(
        *[
            F.struct(
                F.round(correlation_at(F.col("_window"), F.array(*[F.lit(float(x)) for x in wave])), 9).alias("score"),
                F.lit(-number).alias("_order"),
            )
            for number, wave in templates.items()
        ]
    )
    best = aligned.groupBy(key).agg(F.max(F.array_max(scores)).alias("_best"))
    return best.select(key, F.col("_best.score").alias("score"), (-F.col("_best._order")).alias("template"))


def energetic_series(df: DataFrame, key: str, order: str, value: str, n: int, width: int = 65536,
                     digits: int | None = None) -> DataFrame:
    """First most energetic run of ``n`` values per key (``order`` counts from 1), 0-based bounds.

    A series of at most ``n`` values passes through whole. ``digits`` makes energies exact sums of squares rounded to so
    many decimals, so that of equal runs the first is taken (see :func:`rolling_energy`).
    """
    scored = rolling_energy(df, [key], order, value, n, "_energy", width, digits)
    best = F.max_by(F.struct(order, "_energy"), F.when(F.col("_energy").isNotNull(), F.struct(F.col("_energy"), -F.col(order))))
    total = F.sum(squared(value, digits))
    rows = scored.groupBy(key).agg(best.alias("_best"), F.count(F.lit(1)).alias("_len"), total.alias("_total"))
    short = F.col("_len") <= n
    return rows.select(
        key,
        F.when(short, F.lit(0)).otherwise(F.col(f"_best.{order}") - 1).cast("bigint").alias("start"),
        F.when(short, F.col("_len")).otherwise(F.col(f"_best.{order}") - 1 + n).cast("bigint").alias("stop"),
        F.when(short, F.col("_total").cast("double")).otherwise(F.col("_best._energy").cast("double")).alias("energy"),
    )


def energetic_window(df: DataFrame, key: str, samples: str, n: int) -> DataFrame:
    """Template trim: ``key, window, start, stop`` of every row's sample array.

    Arrays of at most ``n`` samples pass through. Of longer ones the first of the most energetic runs of ``n`` samples
    stays, its edges faded; energies are differences of running sums inside the row, so nothing is shuffled. A null array
    gives null columns.
    """
    if n < 1:
        raise ValueError("a window needs a sample at least")
    fade = min(int(FADE_SECONDS * SAMPLE_RATE), n // 10)
    level = np.ones(n)
    if fade > 1:
        level[:fade] *= np.linspace(0.0, 1.0, fade)
        level[-fade:] *= np.linspace(1.0, 0.0, fade)
    schema = T.StructType([df.schema[key], T.StructField("window", T.ArrayType(T.FloatType())), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, line in zip(batch[key], batch[samples]):
                if line is None:
                    rows.append((name, None, None, None))
                    continue
                line = np.asarray(line, dtype=np.float64)
                if len(line) <= n:
                    rows.append((name, line.astype(np.float32), 0, len(line)))
                    continue
                power = np.concatenate([[0.0], np.cumsum(line**2)])
                start = int(np.argmax(power[n:] - power[:-n]))
                rows.append((name, (line[start : start + n] * level).astype(np.float32), start, start + n))
            frame = pd.DataFrame(rows, columns=[key, "window", "start", "stop"])
            yield frame.astype({"start": "Int64", "stop": "Int64"})

    return df.select(key, samples).mapInPandas(run, schema)


def detections(scored: DataFrame, key: str, time: str, tie: str, threshold: float, cooldown_ms: int,
               inclusive: bool = True, score: str = "score", width: int | None = None) -> DataFrame:
    """Threshold, then cooldown. ``inclusive`` tells ``>=`` from ``>``."""
    passed = F.col(score) >= threshold if inclusive else F.col(score) > threshold
    return cooldown(scored.filter(passed), key, time, cooldown_ms, tie, width)


def k_of_n_vote(chunks: DataFrame, clip: str, positive: Column, k: int = 1) -> DataFrame:
    """A clip is positive if at least ``k`` of its chunks are."""
    return chunks.groupBy(clip).agg(
        F.sum(positive.cast("int")).cast("bigint").alias("n_positive"),
        F.count(F.lit(1)).alias("n_chunks"),
    ).withColumn("detected", F.col("n_positive") >= k)


def stale_devices(heartbeats: DataFrame, key: str, time: str, now: Column, max_age_ms: int) -> DataFrame:
    """Devices whose last heartbeat (ms) is older than ``max_age_ms``."""
    last = heartbeats.groupBy(key).agg(F.max(time).alias("last_seen"))
    return last.withColumn("age_ms", now - F.col("last_seen")).filter(F.col("age_ms") > max_age_ms)


def uncertain_rows(df: DataFrame, probability: str, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """Rows the model is unsure about, to label next."""
    return df.filter((F.col(probability) > low) & (F.col(probability) < high))


def analysis_windows(chunks: DataFrame, n: int, key: str = "device_id", seq: str = "seq",
                     pcm: str = "pcm", width: int = 256) -> DataFrame:
    """Every chunk with the bytes of its last ``n`` chunks, cut at sequence gaps.

    Chunks are spread over ``(device, block of chunk numbers)``; a block borrows ``n - 1`` chunks.
    """
    from pyspark.sql import Window

    spread = overlapping_segments(chunks, seq, max(width, n), before=n - 1)
    frame = Window.partitionBy(key, SEGMENT).orderBy(seq).rangeBetween(-(n - 1), 0)
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct(seq, pcm)).over(frame)),
        F.lit(b"").cast("binary"),
        lambda acc, c: F.concat(acc, c[pcm]),
    )
    return spread.withColumn("window", joined).filter("_own").drop("_own", SEGMENT)
