"""Small column expressions over labelled intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.schemas import HOP_LENGTH, NEGATIVE_LABEL, POSITIVE_LABEL, SAMPLE_RATE


def to_ms(seconds: Column | str) -> Column:
    """Seconds to whole milliseconds, truncating."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return (seconds.cast("double") * F.lit(1000)).cast("bigint")


def ms_bounds(start: str = "start", end: str = "end") -> list[Column]:
    return [to_ms(start).alias("start_ms"), to_ms(end).alias("end_ms")]


def sample_offset(ms: Column | str, rate: Column | int = SAMPLE_RATE) -> Column:
    """First sample of a millisecond position: ``int(rate / 1000 * ms)``."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return (rate.cast("double") / F.lit(1000.0) * ms).cast("bigint")


def frame_bounds(
    start_ms: Column, end_ms: Column, rate: int = SAMPLE_RATE, hop: int = HOP_LENGTH
) -> tuple[Column, Column]:
    """First frame and number of frames; the width depends on the length only, so it is constant."""
    per_ms = F.lit(rate / hop / 1000)
    return (per_ms * start_ms).cast("int"), (per_ms * (end_ms - start_ms)).cast("int")


def frame_slice(features: Column, start_ms: Column, end_ms: Column, rate: int = SAMPLE_RATE,
                hop: int = HOP_LENGTH) -> Column:
    """Cut the same frames out of every coefficient row of a 2-D feature array."""
    first, width = frame_bounds(start_ms, end_ms, rate, hop)
    return F.transform(features, lambda row: F.slice(row, first + 1, width))


def binary_label(label: Column | str, negative: str = NEGATIVE_LABEL) -> Column:
    """Everything that is not the negative label, missing ones included, is positive."""
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label.eqNullSafe(F.lit(negative)), F.lit(negative)).otherwise(F.lit(POSITIVE_LABEL))


def label_index(label: Column | str, negative: str = NEGATIVE_LABEL) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label.eqNullSafe(F.lit(negative)), F.lit(0)).otherwise(F.lit(1))


def fill_missing(df: DataFrame, column: str, other: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.col(other)))


def augmented_id(snr: Column, signal: Column, pair: Column) -> Column:
    return F.concat(
        F.lit("aug_snr"), snr.cast("string"), F.lit("_"), signal.cast("string"), F.lit("_"), pair.cast("string")
    )


def noise_id(pool: Column, stem: Column) -> Column:
    return F.concat(F.lit("noise_"), pool.cast("string"), F.lit("_"), stem.cast("string"))


def flatten_features(features: Column) -> Column:
    """Row-major vector of a 2-D array; rows of unequal width are an error."""
    widths = F.array_distinct(F.transform(features, lambda row: F.size(row)))
    return F.when(F.size(widths) <= 1, F.flatten(features)).otherwise(
        F.raise_error(F.lit("feature rows differ in width"))
    )


def feature_column(df: DataFrame) -> tuple[str, str]:
    """Name of the first ``*_features`` column and the feature type it names."""
    for name in df.columns:
        if name.endswith("_features"):
            return name, name.removesuffix("_features")
    raise ValueError("no column ends with '_features'")


def filter_label(df: DataFrame, value: str, negate: bool = False, external: bool | None = None, label: str = "label",
                 pool: str = "noise_pool") -> DataFrame:
    """Rows of one label, or with ``negate`` of all others; ``external`` keeps rows of a pool, or those of none.

    A row without a label belongs to neither side. Both conditions are plain comparisons, which reach the scan.
    """
    kept = df.filter(F.col(label) != F.lit(value) if negate else F.col(label) == F.lit(value))
    if external is None:
        return kept
    return kept.filter(F.col(pool).isNotNull() if external else F.col(pool).isNull())
