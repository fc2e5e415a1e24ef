"""Canonical views over the driver tables: recordings, intervals, windows and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.operators.intervals import slide_windows
from sonarium.operators.ordered import with_next, with_ordinal
from sonarium.session import materialize

HOUR = 3_600_000
DAY = 24 * HOUR
SEGMENT_MS = 7 * DAY
WINDOW = 6 * HOUR
STRIDE = HOUR
SCORE_MAX = 490.02
POOLS = [f"label_{i}" for i in range(1, 10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_label() -> Column:
    return F.when(F.col("event_type") == "purchase", "bell").otherwise("background")


def event_pool() -> Column:
    return F.when(F.col("event_type").isin("error", "signup"), F.col("event_type"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, event_type, value, start_ms``; the clock is in whole milliseconds."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms")
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("score", F.col("value") / F.lit(SCORE_MAX))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their 1-based position per user."""
    return with_ordinal(scored_events(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], SEGMENT_MS, "seq")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``[ts, next ts of the user)`` with a label and, for external background, a pool."""
    rows = events(spark, sf_dir).select(
        "event_id", "user_id", "start_ms", event_label().alias("label"), event_pool().alias("noise_pool")
    )
    return with_next(rows, ["user_id"], ["start_ms", "event_id"], SEGMENT_MS, "start_ms", "end_ms")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slide_windows(intervals(spark, sf_dir), WINDOW, STRIDE).select(
        "event_id", "user_id", "label", "noise_pool", "chunk_start", "chunk_end"
    )


def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows over a written copy of the intervals, for operators that pass over them repeatedly."""
    return slide_windows(materialize(intervals(spark, sf_dir), "intervals"), WINDOW, STRIDE).select(
        "event_id", "user_id", "label", "noise_pool", "chunk_start", "chunk_end"
    )


def signals(spark: SparkSession, sf_dir: str, rate: int = 1000, gain: float = 20000.0) -> DataFrame:
    """Embeddings as short recordings: ``vec_id, path, label, noise_pool, rate, frames, samples``."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("path"),
        "label",
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("noise_pool"),
        F.lit(rate).alias("rate"),
        F.size("embedding").cast("bigint").alias("frames"),
        F.transform("embedding", lambda x: x.cast("double") * F.lit(gain)).alias("samples"),
    )


def checksum(samples: Column | str) -> Column:
    """Position-weighted sum of an array: changes when values or their order do."""
    samples = F.col(samples) if isinstance(samples, str) else samples
    weighted = F.transform(samples, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
