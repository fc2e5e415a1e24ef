"""Leakage-free, stratified train/test split by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.functions.keys import md5_key
from sonarium.operators.lookups import join_hot
from sonarium.operators.sampling import rank_by_digest
from sonarium.schemas import TEST_SIZE
from sonarium.session import materialize


def n_folds(test_size: float) -> int:
    return max(2, round(1 / test_size))


def group_folds(df: DataFrame, group: str, label: str, test_size: float = TEST_SIZE, seed=42) -> DataFrame:
    """``group, group_rows, fold``: groups dealt to folds within strata of class and size.

    A stratum is (most frequent class, power-of-two size band). Groups are ranked by stratum and key
    digest and dealt round robin, so every fold gets its share of each stratum, give or take one.

    The rows are read once: the table of groups is written to the work folder and ranked from there. Rows without a
    group are an error, as they could end on both sides; rows without a class count as a class of their own.
    """
    missing = F.raise_error(F.lit(f"NULL in {group}: a split needs a group for every row")).cast(df.schema[group].dataType)
    df = df.withColumn(group, F.coalesce(group, missing))
    per_class = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    groups = per_class.groupBy(group).agg(
        F.sum("_n").alias("group_rows"),
        F.max_by(label, F.struct("_n", label)).alias("_class"),
    )
    stratified = groups.withColumn("_band", F.length(F.bin("group_rows"))).withColumn(
        "_digest", md5_key(seed, F.col(group))
    )
    ranked = rank_by_digest(materialize(stratified, "groups"), "_digest", "_rank", ["_class", "_band"])
    return ranked.select(
        group, "group_rows", F.pmod(F.col("_rank") - 1, F.lit(n_folds(test_size))).cast("int").alias("fold")
    )


def group_split(df: DataFrame, group: str, label: str, test_size: float = TEST_SIZE, seed=42,
                test_fold: int = 0) -> DataFrame:
    """Rows with ``fold`` and ``is_test``; all rows of a group share a side."""
    folds = materialize(group_folds(df, group, label, test_size, seed), "folds")
    joined = join_hot(df, folds, group, "group_rows")
    return joined.drop("group_rows").withColumn("is_test", F.col("fold") == F.lit(test_fold))


def leakage(df: DataFrame, group: str, side: str = "is_test") -> DataFrame:
    """Groups found on both sides; must be empty."""
    sides = df.groupBy(group).agg(
        F.min(F.col(side).cast("int")).alias("_low"), F.max(F.col(side).cast("int")).alias("_high")
    )
    return sides.filter("_low <> _high").select(group)
