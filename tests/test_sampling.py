"""Sampling, balancing, splitting and look-ups."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from sonarium.operators import lookups, metrics, sampling, splitting


@pytest.mark.parametrize(
    "case,expected",
    [((100, 0.5, 1000, 1000), (50, 50)), ((100, 0.0, 1000, 1000), (100, 0)), ((100, 1.0, 1000, 1000), (0, 100)),
     ((100, 0.2, 30, 1000), (30, 70)), ((100, 0.8, 1000, 10), (90, 10)), ((100, 0.5, 30, 40), (30, 40)),
     ((5, 0.5, 9, 9), (3, 2)), ((7, 0.5, 9, 9), (3, 4))],
)
def test_split_draw(spark, case, expected):
    row = spark.range(1).select(sampling.split_draw(*[F.lit(x) for x in case]).alias("d")).first()
    assert tuple(row.d) == expected


def _digest(*parts):
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 500, 4999, 5000, 9999])
def test_sample_n_is_exact(spark, n):
    df = spark.range(5000)
    got = sorted(r.id for r in sampling.sample_n(df.repartition(1), n, 7, ["id"]).collect())
    want = sorted(sorted(range(5000), key=lambda i: _digest(7, i))[:n])
    assert got == want
    if n == 500:
        assert got == sorted(r.id for r in sampling.sample_n(df.repartition(8), n, 7, ["id"]).collect())


def test_balance(spark):
    rows = [(i, "bell" if i % 20 == 0 else "background", "pool" if i % 3 == 0 else None) for i in range(3000)]
    rows += [(9001, None, None)]  # a missing label is not background, so it stays
    df = spark.createDataFrame(rows, "id int, label string, noise_pool string")
    for ratio, external in ((1.0, 0.5), (2.5, 0.3), (30.0, 0.5)):
        out = sampling.balance(df, ["id"], ratio, external).collect()
        positive = [r for r in rows if r[1] != "background"]
        real = [r[0] for r in rows if r[1] == "background" and r[2] is None]
        ext = [r[0] for r in rows if r[1] == "background" and r[2]]
        target = int(len(positive) * ratio)
        want = spark.range(1).select(sampling.split_draw(F.lit(target), F.lit(external), F.lit(len(real)), F.lit(len(ext))).alias("d")).first().d
        chosen = {r[0] for r in positive}
        chosen |= set(sorted(real, key=lambda i: _digest(42, i))[: want.n_real])
        chosen |= set(sorted(ext, key=lambda i: _digest(42, i))[: want.n_external])
        assert {r.id for r in out} == chosen and len(out) == len(chosen)
    short = sampling.background_shortfall(df, 30.0).first()
    assert short.n_missing == short.n_target - short.n_background > 0


def test_shuffle(spark):
    df = spark.range(2000).repartition(5)
    ranks = {r.id: r.shuffle_rank for r in sampling.shuffle_rank(df, 3, ["id"]).collect()}
    order = sorted(range(2000), key=lambda i: _digest(3, i))
    assert ranks == {i: n + 1 for n, i in enumerate(order)}
    assert [r.id for r in sampling.shuffle(df, 3, ["id"]).collect()] == order


def test_group_split(spark):
    rows = []
    for g in range(300):
        size = 900 if g == 0 else 1 + g % 9
        rows += [(g, f"{g}_{i}", "bell" if (g + i) % 4 == 0 else "background") for i in range(size)]
    df = spark.createDataFrame(rows, "g int, id string, label string")
    split = splitting.group_split(df, "g", "label", 0.2).cache()
    assert split.count() == len(rows)
    assert splitting.leakage(split, "g").count() == 0
    sizes = collections.Counter(r.fold for r in split.select("g", "fold").distinct().collect())
    assert set(sizes) == {0, 1, 2, 3, 4} and max(sizes.values()) - min(sizes.values()) <= 1
    again = splitting.group_split(df.repartition(1), "g", "label", 0.2)
    assert {(r.id, r.fold) for r in split.collect()} == {(r.id, r.fold) for r in again.collect()}
    broken = split.withColumn("is_test", F.when(F.col("id") == "5_0", ~F.col("is_test")).otherwise(F.col("is_test")))
    assert [r.g for r in splitting.leakage(broken, "g").collect()] == [5]
    assert splitting.n_folds(0.2) == 5 and splitting.n_folds(0.9) == 2 and splitting.n_folds(0.4) == 2
    share = metrics.dataset_shape(split.withColumn("f", F.array("g")), "f").first()
    assert share.n_chunks == len(rows) and share.n_features == 1


def test_join_hot_keeps_every_row(spark):
    big = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    out = lookups.join_hot(big, small, "k", "n")
    assert out.count() == 20000 and out.select("id").distinct().count() == 20000


def test_exclude_values(spark):
    df = spark.createDataFrame([("a.wav", "church"), ("b.wav", "vacuum"), ("c.wav", "rain"), ("d.wav", None)], "f string, c string")
    assert sorted(r.f for r in lookups.exclude_values(df, "c", ["church"]).collect()) == ["b.wav", "c.wav", "d.wav"]
    assert lookups.exclude_values(df, "c", []).count() == 4
    with pytest.raises(Exception, match="unknown values to exclude: churches"):
        lookups.exclude_values(df, "c", ["church", "churches"]).collect()


def test_resolve_and_durations(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    one = spark.createDataFrame([("a", "rec/a"), ("b", "rec/b")], "name string, path string")
    two = spark.createDataFrame([("b", "aug/b"), ("c", "aug/c")], "name string, path string")
    found = lookups.resolve_first(names, "name", [(one, "rec"), (two, "aug")])
    assert {r.name: r.path for r in found.collect()} == {"a": "rec/a", "b": "rec/b", "c": "aug/c"}
    with pytest.raises(Exception, match="file not found: c"):
        lookups.resolve_first(names, "name", [(one, "rec")]).collect()
    ann = spark.createDataFrame([("a", 1.0), ("b", None)], "audio_file_name string, end double")
    info = spark.createDataFrame([("a", 5.0), ("b", 7.5)], "audio_file_name string, duration_s double")
    assert {r.audio_file_name: r.end for r in lookups.attach_duration(ann, info).collect()} == {"a": 1.0, "b": 7.5}
    with pytest.raises(Exception, match="no audio for b"):
        lookups.attach_duration(ann, info.filter("audio_file_name = 'a'")).collect()


def test_sync_plan_and_sets(spark):
    want = spark.createDataFrame([("a", "s3://m/2/a"), ("a", "s3://m/1/a"), ("b", "s3://m/b")], "audio_file_name string, remote_audio_path string")
    have = spark.createDataFrame([("b",), ("z",)], "audio_file_name string")
    plan = {r.audio_file_name: (r.remote_audio_path, r.action) for r in lookups.sync_plan(want, have).collect()}
    assert plan == {"a": ("s3://m/1/a", "fetch"), "b": ("s3://m/b", "keep"), "z": (None, "prune")}
    assert [r.audio_file_name for r in lookups.difference(want, have, "audio_file_name").collect()] == ["a"]
    first = lookups.distinct_first(want, ["audio_file_name"], ["remote_audio_path"])
    assert sorted(tuple(r) for r in first.collect()) == [("a", "s3://m/1/a"), ("b", "s3://m/b")]


def test_quality_metrics(spark):
    rows = [("f1", "background")] * 6 + [("f2", "bell"), ("f2", None), (None, "bell")]
    df = spark.createDataFrame(rows, "file_id string, label string")
    row = metrics.quality_metrics(df).first()
    assert (row.total_samples, row.total_files, row.total_labels, row.imbalance_ratio) == (9, 3, 3, 3.0)
    empty = metrics.quality_metrics(df.limit(0)).first()
    assert (empty.total_samples, empty.total_files, empty.total_labels, empty.imbalance_ratio) == (0, 0, 0, None)
    assert [tuple(r) for r in metrics.count_per_label(df).collect()] == [("background", 6), ("bell", 2)]
    assert metrics.positive_total(df).first()[0] == 3


def test_reports(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 0)]
    df = spark.createDataFrame(pairs, "t int, p int")
    report = {r["class"]: r for r in metrics.class_report(df, "t", "p").collect()}
    assert report[0].precision == pytest.approx(5 / 7) and report[0].recall == pytest.approx(5 / 7)
    assert report[2].precision == 0 and report[2].f1 == 0 and report[2].support == 1
    total = metrics.weighted_report(df, "t", "p").first()
    assert total.recall == pytest.approx(8 / 12) and total.support == 12
    matrix = {r.t: (r.pred_0, r.pred_1) for r in metrics.confusion_matrix(df, "t", "p", [0, 1]).collect()}
    assert matrix == {0: (5, 2), 1: (1, 3), 2: (1, 0)}


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 7 > 0, F.col("id") * 2))
    a = metrics.dataset_fingerprint(df, ["id", "x"]).first()
    b = metrics.dataset_fingerprint(df.orderBy(F.desc("id")).repartition(5), ["id", "x"]).first()
    c = metrics.dataset_fingerprint(df.withColumn("x", F.coalesce("x", F.lit(0))), ["id", "x"]).first()
    assert a == b and a != c


def test_window_totals_beyond_a_bigint(spark):
    from sonarium.plans.queries import window_totals

    rows = spark.createDataFrame([("bell", None, 2**62)] * 3 + [("background", "error", 5)], "label string, noise_pool string, chunk_start long")
    got = {(r.label, r.noise_pool): (r.n_windows, int(r.sum_start)) for r in window_totals(rows).collect()}
    assert got == {("bell", None): (3, 3 * 2**62), ("background", "error"): (1, 5)}
    assert window_totals(rows.where("chunk_start = 5")).schema["sum_start"].dataType.typeName() == "long"
