"""NULL keys, repeated keys, missing features and restarted counters: kept or refused, never lost."""

import datetime

import pytest
from pyspark.sql import functions as F

from sonarium.operators import detect, lookups, ordered, sampling, splitting
from sonarium.sources import streams
from sonarium.streaming import detector

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(100).select(
        F.when(F.col("id") >= 10, F.col("id") % 7).alias("k"), "id", (F.col("id") % 3).cast("string").alias("c")
    )


@pytest.mark.parametrize("call", [
    lambda r: ordered.with_ordinal(r, ["k"], ["id"], 10),
    lambda r: ordered.with_next(r, ["k"], ["id"], 10, "id", "following"),
    lambda r: ordered.with_session_position(r, ["k"], ["id"], 10, F.lit(False)),
    lambda r: ordered.with_ordinal(r, ["c"], ["k"], 10),
    lambda r: splitting.group_split(r, "k", "c"),
    lambda r: detect.cooldown(r, "k", "id", 0, tie="id"),
    lambda r: detect.cooldown(r, "k", "id", 5, tie="id"),
])
def test_null_keys_are_refused(rows, call):
    with pytest.raises(Exception, match="NULL in k"):
        call(rows).collect()


def test_rows_without_a_class_stay_in_the_split(rows):
    some = rows.where("k IS NOT NULL").withColumn("c", F.when(F.col("k") != 3, F.col("c")))
    assert splitting.group_split(some, "k", "c").count() == 90


@pytest.mark.parametrize("n", [0, 1, 2, 9, 29, 30, 40])
def test_exactly_n_with_repeated_keys(spark, n):
    frame = spark.range(30).select(F.floor(F.col("id") / 3).alias("k"), "id")
    got = sorted(r.id for r in sampling.sample_n(frame, n, 1, ["k"]).collect())
    assert len(got) == len(set(got)) == min(n, 30)
    assert got == sorted(r.id for r in sampling.sample_n(frame.repartition(5), n, 1, ["k"]).collect())


def test_balance_is_exact_with_repeated_keys(spark):
    frame = spark.range(60).select(
        F.floor(F.col("id") / 4).alias("k"), F.when(F.col("id") < 9, "bell").otherwise("background").alias("label"),
        F.lit(None).cast("string").alias("noise_pool"),
    )
    assert sampling.balance(frame, ["k"], 1.0, 0.0).groupBy().agg(F.count_if(F.col("label") != "bell")).first()[0] == 9


def test_missing_and_short_features(spark):
    table = spark.createDataFrame([("a", [[float(i) for i in range(40)]] * 2)], "audio_file_name string, features array<array<double>>")
    ask = "audio_file_name string, chunk_start long, chunk_end long"
    for chunk in (("b", 0, 100), ("a", 1200, 2000)):
        frame = spark.createDataFrame([chunk], ask)
        with pytest.raises(Exception, match="no features, or too few"):
            lookups.attach_features(frame, table).collect()
        assert lookups.attach_features(frame, table, mode="null").first().mfcc_features is None
    assert lookups.attach_features(spark.createDataFrame([("a", 0, 320)], ask), table).first().mfcc_features[0][0] == 0.0


def test_a_restarted_counter_is_followed(spark, tmp_path):
    rows = [
        ("d", i % 10, START + datetime.timedelta(seconds=i), 1.0, i == 10) for i in range(20)
    ] + [("d", 3, START + datetime.timedelta(seconds=30), 1.0, False)]
    schema = "device_id string, seq long, ts timestamp, score double, is_reset boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = streams.stream_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    settings = detector.DetectorSettings(scorer="given", threshold=0.5, cooldown_ms=0, warm_up=0, every=1, save=False)
    got = streams.run_to_table(detector.detect_stream(source, settings), "restart").orderBy("ts_ms").collect()
    assert [r.seq for r in got] == [*range(10), *range(10)]
