"""Counts, data quality and classification reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.schemas import NEGATIVE_LABEL


def count_per_label(df: DataFrame, label: str = "label") -> DataFrame:
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(label)
    )


def quality_metrics(df: DataFrame, file: str = "file_id", label: str = "label") -> DataFrame:
    """Rows, distinct files, distinct labels (a missing value counts as one) and class imbalance.

    One pass: rows collapse to ``(file, label)`` counts, each of which counts once towards its file and
    once towards its label.
    """
    cells = df.groupBy(file, label).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.lit("file").alias("side"), F.col(file).cast("string").alias("value")),
        F.struct(F.lit("label").alias("side"), F.col(label).cast("string").alias("value")),
    )
    margins = cells.select(F.explode(sides).alias("_s"), "_n").groupBy("_s.side", "_s.value").agg(F.sum("_n").alias("_n"))
    on_label = F.col("side") == "label"
    named = F.when(on_label & F.col("value").isNotNull(), F.col("_n"))
    return margins.agg(
        F.coalesce(F.sum(F.when(on_label, F.col("_n"))), F.lit(0)).alias("total_samples"),
        F.count(F.when(~on_label, 1)).alias("total_files"),
        F.count(F.when(on_label, 1)).alias("total_labels"),
        (F.max(named) / F.min(named)).alias("imbalance_ratio"),
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts, largest first."""
    return count_per_label(df, label).orderBy(F.desc("n"), label)


def positive_total(df: DataFrame, label: str = "label", negative: str = NEGATIVE_LABEL) -> DataFrame:
    # a missing label is not the negative one: balance() counts it as positive too
    return df.filter(~F.col(label).eqNullSafe(negative)).agg(F.count(F.lit(1)).alias("n_positive"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def class_report(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; zero denominators give 0.

    Every row becomes one truth and one prediction mark, combined before the shuffle, so no join of
    the two margins is needed.
    """
    cells = df.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    marks = F.array(
        F.struct(F.col(truth).alias("c"), F.col("_n").alias("t"), zero.alias("p"), hit.cast("bigint").alias("h")),
        F.struct(F.col(predicted).alias("c"), zero.alias("t"), F.col("_n").alias("p"), zero.alias("h")),
    )
    sums = (
        cells.select(*by, F.explode(marks).alias("m"))
        .groupBy(*by, F.col("m.c").alias("class"))
        .agg(F.sum("m.t").alias("support"), F.sum("m.p").alias("_p"), F.sum("m.h").alias("_h"))
    )
    precision, recall = _ratio(F.col("_h"), F.col("_p")), _ratio(F.col("_h"), F.col("support"))
    return sums.select(
        *by, "class", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), "support",
    )


def weighted_report(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    report = class_report(df, truth, predicted, by)

    def weighted(name: str) -> Column:
        return (F.sum(F.col(name) * F.col("support")) / F.sum("support")).alias(name)

    return report.groupBy(*by).agg(weighted("precision"), weighted("recall"), weighted("f1"), F.sum("support").alias("support"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """One row per true class, one column per predicted class."""
    pivot = df.groupBy(truth).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return pivot.select(
        truth, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in classes]
    )


def dataset_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive identity of a table: row count plus four 32-bit sums of the row digests."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    digest = F.md5(text)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"digest_{i}") for i in range(4)
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *parts)


def dataset_shape(df: DataFrame, features: str, is_test: str = "is_test") -> DataFrame:
    """Chunks, features per chunk and realised test fraction."""
    return df.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.max(F.size(features)).alias("n_features"),
        F.round(F.avg(F.col(is_test).cast("int")), 4).alias("realized_test_fraction"),
    )
