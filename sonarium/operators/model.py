"""Training, scoring and evaluating the boosted-tree classifier with pyspark.ml."""

from __future__ import annotations

import functools
import operator

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.functions.scalars import binary_label, feature_column, flatten_features, label_index
from sonarium.operators.metrics import weighted_report

# ---- fixed values: training parameters --------------------------------------------------------
ROUNDS = 25
DEPTH = 6
LEARNING_RATE = 0.1
SEED = 42
# -----------------------------------------------------------------------------------------------


def prepare(df: DataFrame, label: str = "label", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``features VECTOR, target, label`` from the first ``*_features`` column."""
    name, _ = feature_column(df)
    return df.select(
        *keep,
        array_to_vector(flatten_features(F.col(name))).alias("features"),
        binary_label(label).alias("label"),
        label_index(label).cast("double").alias("target"),
    )


def train(prepared: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = LEARNING_RATE,
          seed: int = SEED) -> GBTClassificationModel:
    return GBTClassifier(
        labelCol="target", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed
    ).fit(prepared)


def predict(model: GBTClassificationModel, prepared: DataFrame) -> DataFrame:
    """Adds ``probability`` of the positive class and the 0/1 ``prediction``; checks the vector width."""
    width = F.size(vector_to_array("features"))
    n = model.numFeatures
    checked = prepared.filter(
        F.when(width == n, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit(f"model expects {n} features, got "), width.cast("string"))).cast("boolean")
        )
    )
    scored = model.transform(checked)
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("rawPrediction")


def loss_curve(model: GBTClassificationModel, train_rows: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Train and test loss after every boosting round."""
    on_train = model.evaluateEachIteration(train_rows)
    on_test = model.evaluateEachIteration(test_rows)
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(on_train, on_test))]
    return train_rows.sparkSession.createDataFrame(rows, "round int, train_loss double, test_loss double")


def error_curve(model: GBTClassificationModel, prepared: DataFrame, side: str = "is_test") -> DataFrame:
    """``side, round, n, error_rate``: how many rows each side's predictions miss after every boosting round.

    Every tree sees a row once; the running weighted sums of their values are the margins of all rounds, and one aggregate
    counts the errors of all of them. Nothing is collected.
    """
    staged = prepared.withColumn("side", F.when(F.col(side), "val").otherwise("train"))
    values = []
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        staged = tree.copy().setFeaturesCol("features").setPredictionCol(f"_tree_{i}").transform(staged)
        values.append(F.col(f"_tree_{i}") * F.lit(float(weight)))
    margins = [functools.reduce(operator.add, values[: i + 1]) for i in range(len(values))]
    wrong = [F.count_if((m > 0) != (F.col("target") == 1)).alias(f"_wrong_{i}") for i, m in enumerate(margins)]
    counts = staged.groupBy("side").agg(F.count(F.lit(1)).alias("n"), *wrong)
    rounds = F.array(*[F.struct(F.lit(i + 1).alias("round"), (F.col(f"_wrong_{i}") / F.col("n")).alias("error_rate")) for i in range(len(values))])
    return counts.select("side", "n", F.explode(rounds).alias("r")).select("side", "r.round", "n", "r.error_rate")


def evaluate(scored: DataFrame, side: str = "is_test") -> DataFrame:
    """Weighted precision, recall and F1 per side, named ``train`` and ``val``."""
    named = scored.withColumn("side", F.when(F.col(side), "val").otherwise("train"))
    return weighted_report(named, "target", "prediction", by=["side"])


def save_model(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)
