"""Event-time operators on streams: windows, duplicates, clip joins, silent devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_windows(rows: DataFrame, keys: list[str], size: str, slide: str | None = None, delay: str = "1 minute",
                  time: str = "ts") -> DataFrame:
    """Rows per key and tumbling (or sliding) window."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        rows.withWatermark(time, delay)
        .groupBy(window.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def session_windows(rows: DataFrame, keys: list[str], gap: str, delay: str = "1 minute", time: str = "ts") -> DataFrame:
    """Bursts of rows per key, separated by at least ``gap``."""
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def drop_repeats(rows: DataFrame, keys: list[str], delay: str, time: str = "ts") -> DataFrame:
    """One row per key within the watermark delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rechunk(samples: DataFrame, key: str, size: str, delay: str, time: str = "ts") -> DataFrame:
    """Fixed-length chunks from finer rows: values of a window in time order (a window bounds the list)."""
    packed = F.array_sort(F.collect_list(F.struct(time, "value")))
    return (
        samples.withWatermark(time, delay)
        .groupBy(F.window(time, size).alias("w"), key)
        .agg(F.transform(packed, lambda r: r["value"]).alias("values"))
        .select(key, F.col("w.start").alias("ts"), "values")
    )


def clip_join(detections: DataFrame, chunks: DataFrame, key: str, pre_s: int, post_s: int, delay: str,
              bucket_s: int | None = None) -> DataFrame:
    """Detections joined to the chunks around them, stream to stream.

    Both sides carry watermarks and the time range is bounded, so state is dropped as time moves on. The
    join key includes a time bucket; a detection is copied into the few buckets its range touches, so a
    busy device does not end in one task. ``detections(key, trigger_ts)``, ``chunks(key, ts, ...)``.
    """
    bucket_s = bucket_s or pre_s + post_s

    def bucket(at: Column) -> Column:
        return F.floor(F.unix_seconds(at) / bucket_s).cast("bigint")

    low = F.col("trigger_ts") - F.make_dt_interval(secs=F.lit(pre_s))
    high = F.col("trigger_ts") + F.make_dt_interval(secs=F.lit(post_s))
    left = (
        detections.withWatermark("trigger_ts", delay)
        .withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
        .withColumnRenamed(key, "_key")
    )
    right = chunks.withWatermark("ts", delay).withColumn("_chunk_bucket", bucket(F.col("ts")))
    in_range = (F.col("ts") >= low) & (F.col("ts") <= high)
    joined = left.join(right, (F.col("_key") == F.col(key)) & (F.col("_bucket") == F.col("_chunk_bucket")) & in_range)
    return joined.drop("_bucket", "_chunk_bucket", "_key")


def last_seen(rows: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Newest heartbeat per device (complete or update mode); filter by age at the sink."""
    return rows.groupBy(key).agg(F.max(time).alias("last_seen"))
