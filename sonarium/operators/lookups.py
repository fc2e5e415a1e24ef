"""Joins and set operations by file name, group or chunk number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.scalars import frame_slice

HOT_KEYS = 1000


def join_hot(big: DataFrame, small: DataFrame, on: str, rows: str) -> DataFrame:
    """Inner join whose hot keys are broadcast and whose other keys are shuffled.

    ``small`` has one row per key and knows how many ``rows`` the key has in ``big``. Keys that hold at
    least 1/1000 of all rows number at most 1,000, whatever the data size, so they can be broadcast;
    the rest has no hot key left.
    """
    total = small.agg(F.sum(rows)).scalar()
    is_hot = F.col(rows) * F.lit(HOT_KEYS) >= total
    hot, cold = small.filter(is_hot), small.filter(~is_hot)
    hot_rows = big.join(F.broadcast(hot), on)
    cold_rows = big.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return hot_rows.unionByName(cold_rows)


def resolve_first(names: DataFrame, name: str, sources: Sequence[tuple[DataFrame, str]],
                  mode: str = "fail") -> DataFrame:
    """Attach the path from the first source that holds the name.

    ``sources`` are ``(frame with name and path, label)`` in priority order. A name no source holds is
    an error, or NULL with ``mode='null'``.
    """
    stacked = None
    for priority, (frame, source) in enumerate(sources):
        part = frame.select(
            F.col(name), F.col("path"), F.lit(source).alias("source"), F.lit(priority).alias("_priority")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    best = stacked.groupBy(name).agg(
        F.min_by(F.struct("path", "source"), F.struct("_priority", "path")).alias("_best")
    )
    joined = names.join(best, name, "left")
    path = F.col("_best.path")
    if mode == "fail":
        missing = F.raise_error(F.concat(F.lit("file not found: "), F.col(name))).cast("string")
        path = F.coalesce(path, missing)
    return joined.withColumn("path", path).withColumn("source", F.col("_best.source")).drop("_best")


def attach_duration(annotations: DataFrame, info: DataFrame, name: str = "audio_file_name",
                    mode: str = "fail", keep: Sequence[str] = ()) -> DataFrame:
    """Add ``audio_file_duration`` by file name and fill open ends with it; a missing file is an error.

    ``keep`` names further info columns to carry along.
    """
    durations = info.select(F.col(name), F.col("duration_s").alias("audio_file_duration"), *keep)
    joined = annotations.join(durations, name, "left")
    if mode == "fail":
        missing = F.raise_error(F.concat(F.lit("no audio for "), F.col(name))).cast("double")
        joined = joined.withColumn("audio_file_duration", F.coalesce("audio_file_duration", missing))
    return joined.withColumn("end", F.coalesce("end", "audio_file_duration"))


def attach_features(chunks: DataFrame, features: DataFrame, name: str = "audio_file_name",
                    frames_per_tile: int = 256, rate: int = 16000, hop: int = 512, mode: str = "fail") -> DataFrame:
    """Frames of every chunk from the per-file feature arrays (``name, features``).

    A missing file, or one too short for the chunk, is an error, or NULL with ``mode='null'``.

    Call it after sampling. Files are cut into tiles twice ``frames_per_tile`` wide first, so a chunk
    meets only the tile its frames lie in: no join row carries a whole file, and a file with very many
    chunks spreads over its tiles. ``frames_per_tile`` must be at least the chunk width in frames.
    """
    from sonarium.functions.scalars import frame_bounds

    first, width = frame_bounds(F.col("chunk_start"), F.col("chunk_end"), rate, hop)
    n_frames = F.size(F.element_at("features", 1))
    tile = F.lit(frames_per_tile)
    last_tile = F.floor((n_frames - 1) / tile).cast("int")
    tiles = (
        features.select(name, "features", F.explode(F.sequence(F.lit(0), last_tile)).alias("_tile"))
        .select(
            name,
            "_tile",
            F.transform("features", lambda row: F.slice(row, F.col("_tile") * tile + 1, tile * 2)).alias("_part"),
        )
    )
    located = chunks.withColumn("_first", first).withColumn("_width", width).withColumn(
        "_tile", F.floor(F.col("_first") / tile).cast("int")
    )
    too_wide = F.raise_error(F.lit("chunk is wider than a feature tile")).cast("int")
    start = F.when(F.col("_width") > tile, too_wide).otherwise(F.pmod(F.col("_first"), tile))
    frames = F.col("_frames")
    enough = frames.isNotNull() & (F.size(frames) > 0) & F.forall(frames, lambda row: F.size(row) == F.col("_width"))
    short = F.raise_error(F.concat(F.lit("no features, or too few, for "), F.coalesce(F.col(name).cast("string"), F.lit("NULL"))))
    return (
        located.join(tiles, [name, "_tile"], "left")
        .withColumn("_frames", F.transform("_part", lambda row: F.slice(row, start + 1, F.col("_width"))))
        .withColumn("mfcc_features", F.when(enough, frames).otherwise(short.cast(features.schema["features"].dataType) if mode == "fail" else F.lit(None)))
        .drop("_frames", "_first", "_width", "_tile", "_part")
    )


def cut_features(df: DataFrame, features: str, start_ms: str = "chunk_start", end_ms: str = "chunk_end",
                 rate: int = 16000, hop: int = 512) -> DataFrame:
    """Frame slice where the chunk row already carries its file's features."""
    return df.withColumn(
        "mfcc_features", frame_slice(F.col(features), F.col(start_ms), F.col(end_ms), rate, hop)
    )


def attach_samples(windows: DataFrame, audio: DataFrame, length: int, name: str = "path", mode: str = "fail",
                   known: DataFrame | None = None) -> DataFrame:
    """Samples of every indexed window (``start_sample``, constant ``length``) of the decoded audio.

    A window of a recording that the audio does not have (or of none) is an error, or stays with a NULL ``window`` with
    ``mode='null'``. Windows that run past the end of a recording are left out. ``known`` names the recordings where a
    list is cheaper than reading ``audio`` once more for its names.

    Audio is cut into tiles of ``2 * length`` samples every ``length`` samples, so each window lies in
    exactly one tile, the join never copies a whole recording per window, and a recording with very
    many windows spreads over its tiles.
    """
    step = F.lit(length)
    located = windows.withColumn("_tile", F.floor(F.col("start_sample") / step).cast("bigint"))
    names = (audio if known is None else known).select(name).distinct().withColumn("_known", F.lit(True))
    located = located.join(names, name, "left")
    if mode == "fail":
        missing = F.raise_error(F.concat(F.lit("no audio for "), F.coalesce(F.col(name).cast("string"), F.lit("NULL"))))
        located = located.withColumn("_known", F.coalesce("_known", missing.cast("boolean")))
    count = F.floor((F.col("frames") - 1) / step).cast("bigint")
    tiles = (
        audio.filter(F.col("frames") > 0)
        .select(name, "samples", F.explode(F.sequence(F.lit(0).cast("bigint"), count)).alias("_tile"))
        .select(
            name,
            "_tile",
            F.slice("samples", (F.col("_tile") * step + 1).cast("int"), F.lit(2 * length)).alias("_part"),
        )
    )
    start = F.pmod(F.col("start_sample"), step).cast("int") + 1
    return (
        located.join(tiles, [name, "_tile"], "left")
        .withColumn("window", F.slice("_part", start, F.lit(length)))
        # asked of every row, so that a missing recording cannot be filtered away unseen
        .filter((F.size("window") == length) | F.col("_known").isNull())
        .drop("_tile", "_part", "_known")
    )


def clip_range(detections: DataFrame, chunks: DataFrame, low: Column, high: Column, width: int,
               key: str = "device_id", seq: str = "seq") -> DataFrame:
    """Chunks with ``seq`` in ``[low, high]`` of the same device, one row each.

    Both sides meet on ``(device, block of width chunk numbers)``; a detection is copied only into the
    blocks its range touches, so a busy device spreads over its blocks.
    """
    bounded = detections.withColumn("_low", low).withColumn("_high", high)
    first, last = F.floor(F.col("_low") / width).cast("bigint"), F.floor(F.col("_high") / width).cast("bigint")
    wanted = bounded.withColumn("_block", F.explode(F.sequence(first, last)))
    blocked = chunks.withColumn("_block", F.floor(F.col(seq) / width).cast("bigint"))
    return (
        blocked.join(wanted, [key, "_block"])
        .filter((F.col(seq) >= F.col("_low")) & (F.col(seq) <= F.col("_high")))
        .drop("_block", "_low", "_high")
    )


def clip_context(detections: DataFrame, chunks: DataFrame, pre: int, post: int, key: str = "device_id",
                 seq: str = "seq", trigger: str = "trigger_seq", width: int | None = None) -> DataFrame:
    """Chunks ``seq`` in ``[trigger - pre + 1, trigger + post]`` of the same device, one row each."""
    return clip_range(
        detections, chunks, F.col(trigger) - pre + 1, F.col(trigger) + post, width or max(64, pre + post), key, seq
    )


def assemble_clips(context: DataFrame, value: str = "pcm", key: str = "device_id", seq: str = "seq",
                   trigger: str = "trigger_seq") -> DataFrame:
    """One row per clip with its buffers in order; a clip has at most ``pre + post`` chunks."""
    packed = F.array_sort(F.collect_list(F.struct(seq, value)))
    return (
        context.groupBy(key, trigger)
        .agg(
            packed.alias("_chunks"),
            F.count(F.when(F.col(seq) <= F.col(trigger), 1)).alias("n_pre"),
            F.count(F.when(F.col(seq) > F.col(trigger), 1)).alias("n_post"),
        )
        .withColumn("frames", F.transform("_chunks", lambda c: c[value]))
        .drop("_chunks")
    )


def exclude_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Drop the listed values; a listed value that never occurs is an error, not a silent no-op."""
    if not values:
        return df
    found = df.filter(F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.array(*[F.lit(v) for v in values])
    unknown = F.array_sort(F.array_except(wanted, F.coalesce(F.collect_set(column), F.array().cast("array<string>"))))
    check = found.agg(unknown.alias("_unknown")).select(
        F.when(F.size("_unknown") == 0, F.lit(True))
        .otherwise(F.raise_error(F.concat(F.lit("unknown values to exclude: "), F.array_join("_unknown", ", "))).cast("boolean"))
        .alias("_known")
    )
    keep = ~F.col(column).isin(*values) | F.col(column).isNull()
    return df.filter(keep & check.scalar())


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``, by aggregation (combines before the shuffle)."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return best.select(*keys, "_first.*").select(*df.columns)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def sync_plan(expected: DataFrame, existing: DataFrame, name: str = "audio_file_name",
              order: str = "remote_audio_path") -> DataFrame:
    """``name, remote path, action``: ``fetch`` what is missing, ``keep`` what is there, ``prune`` the rest.

    One full outer join of the two distinct name lists decides all three.
    """
    want = expected.groupBy(name).agg(F.min(order).alias(order))
    have = existing.select(name).distinct().withColumn("_have", F.lit(True))
    wanted = want.withColumn("_want", F.lit(True))
    action = (
        F.when(F.col("_have").isNull(), "fetch").when(F.col("_want").isNull(), "prune").otherwise("keep")
    )
    return wanted.join(have, name, "full").select(name, order, action.alias("action"))


def order_by_name(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def pool_of(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.element_at(F.split(path, "/"), -2)
