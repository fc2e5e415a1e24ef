"""Driver queries that train and apply the classifier on the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.operators import detect, model, splitting
from sonarium.plans import canonical as c
from sonarium.session import materialize, work_dir

Spark = SparkSession


def training_set(spark: Spark, d: str) -> DataFrame:
    """``embedding_features`` as a 2 x 32 array; labels 0-4 are background; 50 recordings as groups."""
    rows = c.table(spark, d, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 50).alias("recording"),
        F.when(F.col("label") < 5, "background").otherwise(F.concat(F.lit("bell_"), F.col("label").cast("string"))).alias("label"),
        F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("embedding_features"),
    )
    split = splitting.group_split(rows.withColumn("class", F.col("label") == "background"), "recording", "class")
    return model.prepare(split, keep=("vec_id", "recording", "is_test"))


def _trained(spark: Spark, d: str):
    """A model trained on the train side, through its saved form, and all rows."""
    rows = materialize(training_set(spark, d), "training")
    path = work_dir(spark, "model")
    model.save_model(model.train(rows.filter("NOT is_test")), path)
    return model.load_model(path), rows


def train_eval(spark: Spark, d: str) -> DataFrame:
    trained, rows = _trained(spark, d)
    return model.evaluate(model.predict(trained, rows))


def loss_curve(spark: Spark, d: str) -> DataFrame:
    trained, rows = _trained(spark, d)
    return model.loss_curve(trained, rows.filter("NOT is_test"), rows.filter("is_test"))


def predict(spark: Spark, d: str) -> DataFrame:
    trained, rows = _trained(spark, d)
    return model.predict(trained, rows).select("vec_id", "is_test", "label", "probability", "prediction")


def relabel_next(spark: Spark, d: str) -> DataFrame:
    """Rows the model is unsure about."""
    return detect.uncertain_rows(predict(spark, d), "probability")


def model_flow(spark: Spark, d: str) -> DataFrame:
    """Train, save, load and predict: what must hold of every row's prediction, whatever the trees."""
    rows = materialize(training_set(spark, d), "training")
    trained, path = model.train(rows.filter("NOT is_test")), work_dir(spark, "model")
    model.save_model(trained, path)
    here = model.predict(trained, rows).select("vec_id", F.col("probability").alias("before"))
    scored = model.predict(model.load_model(path), rows).join(here, "vec_id")
    return scored.select(
        "vec_id", "is_test", "label", F.col("target").cast("int").alias("target"), F.col("probability").between(0, 1).alias("in_range"),
        ((F.col("probability") > 0.5) == (F.col("prediction") == 1)).alias("agrees"), (F.col("probability") == F.col("before")).alias("reloaded"),
    )


def error_curve(spark: Spark, d: str) -> DataFrame:
    """Errors of both sides after every round: their rows, and that the last round is the prediction."""
    trained, rows = _trained(spark, d)
    curve = model.error_curve(trained, rows)
    side = F.when(F.col("is_test"), "val").otherwise("train").alias("side")
    final = model.predict(trained, rows).groupBy(side).agg(F.avg((F.col("prediction") != F.col("target")).cast("int")).alias("final"))
    last = (F.col("round") < model.ROUNDS) | (F.abs(F.col("error_rate") - F.col("final")) < 1e-12)
    return curve.join(final, "side").select("side", "round", "n", F.col("error_rate").between(0, 1).alias("in_range"), last.alias("last_is_prediction"))


def training_rows(spark: Spark, d: str) -> DataFrame:
    """What the trainer sees: encoded target, side and vector width of every row."""
    from pyspark.ml.functions import vector_to_array

    return training_set(spark, d).select(
        "vec_id", "is_test", "label", F.col("target").cast("int").alias("target"),
        F.size(vector_to_array("features")).alias("n_features"),
        F.round(c.checksum(vector_to_array("features")), 5).alias("checksum"),
    )


MODELS = {f.__name__: f for f in (training_rows, train_eval, loss_curve, error_curve, predict, relabel_next, model_flow)}
