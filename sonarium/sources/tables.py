"""Table sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium import schemas


def read_label_export(spark: SparkSession, path: str) -> DataFrame:
    """CSV export, one row per task; the JSON cell uses doubled quotes."""
    return spark.read.csv(path, schema=schemas.LABEL_EXPORT, header=True, quote='"', escape='"')


def read_annotations(spark: SparkSession, path: str, augmented: bool = False, indexed: bool = False) -> DataFrame:
    """Annotation CSV; ``indexed`` files start with an unnamed row-number column, kept as ``seq``."""
    schema = schemas.AUGMENTED_ANNOTATIONS if augmented else schemas.ANNOTATIONS
    if indexed:
        schema = T.StructType([T.StructField("seq", T.LongType()), *schema.fields])
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


def read_category_list(spark: SparkSession, path: str) -> DataFrame:
    """``filename, category`` of an external pool's metadata CSV (other columns are ignored)."""
    return spark.read.csv(path, header=True).select("filename", "category")


def read_features(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """Feature table; ``labels`` prunes partitions of a table written by label."""
    table = spark.read.parquet(path)
    return table.filter(F.col("label").isin(*labels)) if labels else table
