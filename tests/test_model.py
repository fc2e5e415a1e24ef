"""Training, scoring, saving and evaluating."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.operators import model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(400):
        positive = i % 2 == 0
        x = rng.normal(1.5 if positive else -1.5, 1.0, (2, 3))
        data.append((i, "front_bell" if positive else "background", i % 5 == 0, x.tolist()))
    return spark.createDataFrame(data, "id int, label string, is_test boolean, mfcc_features array<array<double>>")


def test_train_predict_evaluate_save(spark, rows, tmp_path):
    prepared = model.prepare(rows, keep=("id", "is_test")).cache()
    train, test = prepared.filter("NOT is_test"), prepared.filter("is_test")
    fitted = model.train(train, rounds=5, depth=3)
    scored = model.predict(fitted, prepared)
    report = {r.side: r for r in model.evaluate(scored).collect()}
    assert set(report) == {"train", "val"} and report["val"].f1 > 0.9 and report["val"].support == 80
    curve = model.loss_curve(fitted, train, test).orderBy("round").collect()
    assert len(curve) == 5 and curve[-1].train_loss < curve[0].train_loss
    staged = {(r.side, r.round): (r.n, r.error_rate) for r in model.error_curve(fitted, prepared).collect()}
    seen = prepared.select("features", "target", "is_test").collect()
    for side, on in (("train", False), ("val", True)):
        mine = [r for r in seen if r.is_test == on]
        margin = np.zeros(len(mine))
        for i, (tree, weight) in enumerate(zip(fitted.trees, fitted.treeWeights)):
            margin += [weight * tree.predict(r.features) for r in mine]
            wrong = np.mean((margin > 0) != np.array([r.target == 1 for r in mine]))
            assert staged[side, i + 1] == (len(mine), pytest.approx(wrong))
        last = scored.where(F.col("is_test") == on).agg(F.avg((F.col("prediction") != F.col("target")).cast("int"))).first()[0]
        assert staged[side, 5][1] == pytest.approx(last)
    assert len(staged) == 10
    model.save_model(fitted, str(tmp_path / "m"))
    again = model.predict(model.load_model(str(tmp_path / "m")), prepared)
    a, b = [{r.id: r.probability for r in df.collect()} for df in (scored, again)]
    assert a == b and all((p > 0.5) == (r.prediction == 1.0) for r in scored.collect() for p in [r.probability])
    narrow = rows.withColumn("mfcc_features", F.slice("mfcc_features", 1, 1))
    with pytest.raises(Exception, match="model expects 6 features"):
        model.predict(fitted, model.prepare(narrow)).collect()
