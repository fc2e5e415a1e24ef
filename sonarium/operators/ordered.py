"""Ordered per-key computations that never sort one whole key in one task.

A key (device, recording, user) may hold a large share of all rows, so a plain window over the key
would end in a single task. Rows are therefore cut into segments along the order column; windows run
inside ``(key, segment)`` and what has to cross a segment border travels through a small summary with
one row per ``(key, segment)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "_segment"


def with_segment(df: DataFrame, order: str, width: int, name: str = SEGMENT, keys: Sequence[str] = ()) -> DataFrame:
    """``floor(order / width)``; ``width`` bounds how many rows of one key meet in one task.

    A NULL order value has no place and a NULL key no sequence: both are an error, as the joins on segments would
    lose such rows.
    """
    for column in (order, *keys):
        missing = F.raise_error(F.lit(f"NULL in {column}: ordered operators need a value")).cast(df.schema[column].dataType)
        df = df.withColumn(column, F.coalesce(column, missing))
    return df.withColumn(name, F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def _local(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, name: str = "ordinal"
) -> DataFrame:
    """Exact 1-based row number per key: local row number plus the rows of earlier segments."""
    rows = with_segment(df, order[0], width, keys=keys)
    offsets = (
        rows.groupBy(*keys, SEGMENT)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, SEGMENT, F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)).alias("_offset"))
    )
    numbered = rows.withColumn("_local", F.row_number().over(_local(keys, order)))
    return (
        numbered.join(offsets, [*keys, SEGMENT])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_offset", "_local", SEGMENT)
    )


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, value: str, name: str
) -> DataFrame:
    """``lead(value)`` per key; the last row of a segment takes the head of the next one.

    ``value`` must be the leading order column (or grow with it), as interval starts do.
    """
    rows = with_segment(df, order[0], width, keys=keys)
    later = Window.partitionBy(*keys).orderBy(SEGMENT)
    heads = (
        rows.groupBy(*keys, SEGMENT)
        .agg(F.min(value).alias("_head"))
        .select(*keys, SEGMENT, F.lead("_head").over(later).alias("_next_head"))
    )
    local = rows.withColumn("_next", F.lead(value).over(_local(keys, order)))
    return (
        local.join(heads, [*keys, SEGMENT])
        .withColumn(name, F.coalesce("_next", "_next_head"))
        .drop("_next", "_next_head", SEGMENT)
    )


def with_session_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, reset: Column,
    session: str = "session", position: str = "position",
) -> DataFrame:
    """Session number (running count of reset rows) and 1-based position inside the session.

    A reset row starts a new session and is its first row.
    """
    rows = with_segment(df, order[0], width, keys=keys).withColumn("_reset", F.coalesce(reset, F.lit(False)))
    running = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = (
        rows.withColumn("_local", F.row_number().over(_local(keys, order)))
        .withColumn("_resets", F.sum(F.col("_reset").cast("bigint")).over(running))
        .withColumn("_start", F.max(F.when(F.col("_reset"), F.col("_local"))).over(running))
    )
    # The last reset of a segment lies as many rows before the segment end as rows follow it.
    summary = (
        local.groupBy(*keys, SEGMENT)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max("_resets").alias("_seg_resets"),
            F.max("_start").alias("_seg_start"),
        )
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)))
        .withColumn("_session0", F.coalesce(F.sum("_seg_resets").over(_before(keys)), F.lit(0)))
        .withColumn(
            "_start0", F.coalesce(F.max(F.col("_offset") + F.col("_seg_start")).over(_before(keys)), F.lit(1))
        )
        .select(*keys, SEGMENT, "_offset", "_session0", "_start0")
    )
    start = F.coalesce(F.col("_offset") + F.col("_start"), F.col("_start0"))
    return (
        local.join(summary, [*keys, SEGMENT])
        .withColumn(session, (F.col("_session0") + F.col("_resets")).cast("bigint"))
        .withColumn(position, (F.col("_offset") + F.col("_local") - start + 1).cast("bigint"))
        .drop("_local", "_resets", "_start", "_reset", "_offset", "_session0", "_start0", SEGMENT)
    )


def overlapping_segments(df: DataFrame, order: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy rows near a segment border into the neighbour that needs them as context.

    Adds ``_segment`` and ``_own`` (true for the one home copy). ``order`` must be a dense number;
    a segment then sees ``before`` rows of its predecessor and ``after`` rows of its successor.
    """
    if before > width or after > width:
        raise ValueError("context must not exceed the segment width")
    home = F.floor(F.col(order) / F.lit(width)).cast("bigint")
    offset = F.pmod(F.col(order), F.lit(width))
    targets = F.array(home)
    if before:
        targets = F.concat(targets, F.when(offset >= width - before, F.array(home + 1)).otherwise(F.array().cast("array<bigint>")))
    if after:
        targets = F.concat(targets, F.when(offset < after, F.array(home - 1)).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(SEGMENT, F.explode(targets)).withColumn("_own", F.col(SEGMENT) == home)


def rolling_list(
    df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, name: str,
    width: int = 4096, ahead: bool = False,
) -> DataFrame:
    """The last ``n`` values including the current row (or the next ``n`` if ``ahead``), in order.

    One shuffle on ``(key, segment)`` with ``(n - 1) / width`` extra rows.
    """
    width = max(width, n)
    if ahead:
        spread = overlapping_segments(df, order, width, after=n - 1)
        frame = _local(keys, [order]).rowsBetween(0, n - 1)
    else:
        spread = overlapping_segments(df, order, width, before=n - 1)
        frame = _local(keys, [order]).rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn(name, F.collect_list(value).over(frame)).filter("_own").drop("_own", SEGMENT)
    )


def rolling_context(df: DataFrame, keys: Sequence[str], order: str, value: str, window_s: float,
                    chunk_s: float, name: str = "context", width: int = 4096) -> DataFrame:
    """Analysis window of every chunk: the last ``max(1, round(window_s / chunk_s))`` chunks."""
    return rolling_list(df, keys, order, value, max(1, round(window_s / chunk_s)), name, width)


def squared(value: str, digits: int | None = None) -> Column:
    """The square as a double, or rounded to ``digits`` decimals as a decimal."""
    square = F.col(value).cast("double") * F.col(value).cast("double")
    return square if digits is None else square.cast(f"decimal(28,{digits})")


def rolling_energy(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int,
                   name: str = "energy", width: int = 65536, digits: int | None = None) -> DataFrame:
    """Energy of the ``n`` values that start at each row; rows with a shorter tail give NULL.

    With ``digits`` squares are rounded to so many decimals and added exactly, as decimals, so runs of equal energy are
    equal wherever they stand; without, sums are doubles, whose last digits depend on what stands before.
    """
    width = max(width, n)
    spread = overlapping_segments(df, order, width, after=n - 1)
    ordered = _local(keys, [order])
    square = squared(value, digits)
    # difference of running sums: the cost per row does not depend on n
    running = spread.withColumn("_square", square).withColumn(
        "_upto", F.sum("_square").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        running.withColumn(name, F.lead("_upto", n - 1).over(ordered) - F.col("_upto") + F.col("_square"))
        .filter("_own")
        .drop("_own", "_square", "_upto", SEGMENT)
    )


def warm_up(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, n: int, reset: Column) -> DataFrame:
    """Drop the first ``n`` rows after the start and after every stream reset."""
    return with_session_position(df, keys, order, width, reset).filter(F.col("position") > n)


def throttle(positioned: DataFrame, k: int, skipped: int = 0) -> DataFrame:
    """Keep every ``k``-th row, counting from 1 after ``skipped`` warm-up rows of the session."""
    return positioned.filter(F.pmod(F.col("position") - F.lit(skipped), F.lit(k)) == 0)
