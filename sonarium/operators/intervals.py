"""From nested label exports to one row per interval, and from intervals to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.binding import bind
from sonarium.functions.scalars import sample_offset, to_ms
from sonarium.functions.uri import file_name, normalize_uri
from sonarium.schemas import LABEL_JSON, NEGATIVE_LABEL

# Windows of one interval are generated in blocks of this many, so no row ever builds a long array.
WINDOW_BLOCK = 4096


def explode_annotations(export: DataFrame, keep_order: bool = False) -> DataFrame:
    """One row per interval and label of a label export.

    A blank label cell makes one whole-file background row with an open end; an empty JSON array or
    an empty ``labels`` list makes none; malformed JSON or missing keys are an error.
    """
    blank = F.coalesce(F.trim("label") == "", F.lit(True))
    problem = F.concat(F.lit("bad label JSON in annotation "), F.col("annotation_id").cast("string"))

    def checked(parsed: Column) -> Column:
        incomplete = F.exists(
            parsed,
            lambda a: a.isNull()
            | a["labels"].isNull()
            | ((F.size(a["labels"]) > 0) & (a["start"].isNull() | a["end"].isNull())),
        )
        return F.when(
            F.coalesce(incomplete, F.lit(True)), F.raise_error(problem).cast(LABEL_JSON)
        ).otherwise(parsed)

    whole_file = F.array(
        F.struct(
            F.lit(0.0).alias("start"),
            F.lit(None).cast("double").alias("end"),
            F.array(F.lit(NEGATIVE_LABEL)).alias("labels"),
            F.lit(0).alias("channel"),
        )
    )
    items = F.when(blank, whole_file).otherwise(bind(F.from_json("label", LABEL_JSON), checked))
    # everything about the file is settled before its intervals multiply the row
    rows = (
        export.withColumn("remote_audio_path", normalize_uri("audio"))
        .withColumn("audio_file_name", file_name("remote_audio_path"))
        .select(
            "annotation_id", "id", "remote_audio_path", "audio_file_name", F.posexplode(items).alias("_item", "_interval")
        )
        .select("*", F.posexplode("_interval.labels").alias("_pos", "_label"))
    )
    order = [F.col("_item").alias("interval_no"), F.col("_pos").alias("label_no")] if keep_order else []
    return rows.select(
        F.col("annotation_id").cast("string").alias("annotation_id"),
        F.col("id").cast("string").alias("file_id"),
        F.col("_interval.start").alias("start"),
        F.col("_interval.end").alias("end"),
        F.col("_label").alias("label"),
        "audio_file_name",
        "remote_audio_path",
        *order,
    )


def window_count(start_ms: Column, end_ms: Column, size: int, stride: int, include_last: bool = False) -> Column:
    """How many windows :func:`slide_windows` makes of an interval (closed form)."""
    span = end_ms - F.lit(size) - start_ms + F.lit(1 if include_last else 0)
    return F.greatest(F.lit(0), F.ceil(span / F.lit(stride))).cast("bigint")


def expand_windows(df: DataFrame, start_ms: str, count: str, stride: int, spread: int | None = None) -> DataFrame:
    """``count`` starts from ``start_ms`` in steps of ``stride``, block by block.

    ``spread`` redistributes the blocks (not the windows) over that many partitions, for inputs where
    few intervals make most of the windows.
    """
    last_block = F.floor((F.col(count) - 1) / F.lit(WINDOW_BLOCK)).cast("bigint")
    blocks = df.filter(F.col(count) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    if spread:
        blocks = blocks.repartition(spread)
    first = F.col("_block") * WINDOW_BLOCK
    last = F.least(F.col(count), first + WINDOW_BLOCK) - 1
    return (
        blocks.withColumn("_no", F.explode(F.sequence(first, last)))
        .withColumn("chunk_start", F.col(start_ms) + F.col("_no") * F.lit(stride))
        .drop("_block", "_no")
    )


def slide_windows(
    df: DataFrame, size: int, stride: int, start_ms: str = "start_ms", end_ms: str = "end_ms",
    include_last: bool = False, spread: int | None = None,
) -> DataFrame:
    """Fixed windows over every interval: starts ``range(start, end - size, stride)``.

    The range excludes its end, so an interval of exactly ``size`` yields nothing unless
    ``include_last`` is set.
    """
    counted = df.withColumn("_n", window_count(F.col(start_ms), F.col(end_ms), size, stride, include_last))
    return (
        expand_windows(counted, start_ms, "_n", stride, spread)
        .drop("_n")
        .withColumn("chunk_end", F.col("chunk_start") + F.lit(size))
    )


def with_bounds(df: DataFrame) -> DataFrame:
    """Add ``start_ms`` and ``end_ms`` to an annotation table in seconds."""
    return df.withColumn("start_ms", to_ms("start")).withColumn("end_ms", to_ms("end"))


def indexed_count(start_ms: Column, end_ms: Column, rate: Column, frames: Column, size: int, stride: int) -> Column:
    """Windows of an interval that also lie inside the file, in closed form.

    The quotient can be off by one through rounding, so both neighbours are checked exactly.
    """
    per_ms = rate.cast("double") / F.lit(1000.0)
    length = sample_offset(F.lit(size), rate)

    def fits(no: Column) -> Column:
        start = start_ms + no * F.lit(stride)
        return (start < end_ms - F.lit(size)) & (sample_offset(start, rate) + length <= frames)

    bound = F.least(end_ms - F.lit(size), F.ceil((frames - length + 1) / per_ms))
    n = F.greatest(F.lit(0), F.ceil((bound - start_ms) / F.lit(stride))).cast("bigint")
    return F.when(fits(n), n + 1).when((n > 0) & ~fits(n - 1), n - 1).otherwise(n)


def index_windows(intervals: DataFrame, size: int, stride: int) -> DataFrame:
    """Window index ``start_sample, length`` (no samples) of intervals that carry rate and frames.

    Needs ``start_ms, end_ms, rate, frames``; windows beyond the file end are left out.
    """
    counted = intervals.withColumn(
        "_n", indexed_count(F.col("start_ms"), F.col("end_ms"), F.col("rate"), F.col("frames"), size, stride)
    )
    return (
        expand_windows(counted, "start_ms", "_n", stride)
        .withColumn("start_sample", sample_offset("chunk_start", F.col("rate")))
        .withColumn("length", sample_offset(F.lit(size), F.col("rate")))
        .drop("_n")
    )


def index_pool(info: DataFrame, size: int, stride: int) -> DataFrame:
    """Window index over whole files (``path, rate, frames``), e.g. an external noise pool."""
    whole = info.withColumn("start_ms", F.lit(0).cast("bigint")).withColumn(
        "end_ms", (F.col("frames") / F.col("rate") * F.lit(1000)).cast("bigint")
    )
    return index_windows(whole, size, stride)


def pool_rows(info: DataFrame, pool: Column) -> DataFrame:
    """One open-ended background annotation per external noise file."""
    from sonarium.functions.scalars import noise_id

    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return info.select(
        noise_id(pool, stem).alias("annotation_id"),
        noise_id(pool, stem).alias("file_id"),
        F.lit(0.0).alias("start"),
        F.lit(None).cast("double").alias("end"),
        F.lit(NEGATIVE_LABEL).alias("label"),
        name.alias("audio_file_name"),
        F.lit("").alias("remote_audio_path"),
        pool.alias("noise_pool"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """Append real, augmented and pool rows; columns a source lacks are NULL."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def unannotated(tasks: DataFrame, annotations: DataFrame, task_key: str, annotation_key: str) -> DataFrame:
    """Tasks without any annotation."""
    seen = annotations.select(F.col(annotation_key).alias(task_key)).distinct()
    return tasks.join(seen, task_key, "left_anti")


# ---- fixed values: the interval given to a task nobody annotated ----------------------------
DEFAULT_START_S = 0.0
DEFAULT_END_S = 7.0
DEFAULT_CHANNEL = 0
# ---------------------------------------------------------------------------------------------


def default_annotation(tasks: DataFrame) -> DataFrame:
    """Give every (unannotated) task one background interval."""
    return (
        tasks.withColumn("start", F.lit(DEFAULT_START_S))
        .withColumn("end", F.lit(DEFAULT_END_S))
        .withColumn("channel", F.lit(DEFAULT_CHANNEL))
        .withColumn("labels", F.array(F.lit(NEGATIVE_LABEL)))
    )
