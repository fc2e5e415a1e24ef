"""References, label exports, default annotations and CSV round trips."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from sonarium.functions import scalars, uri
from sonarium.operators import intervals
from sonarium.sources import sinks, tables

GOOD = {
    "s3://media/raw/a_1.wav": "s3://media/raw/a_1.wav",
    "s3://media/raw/a_1.wav?versionId=3": "s3://media/raw/a_1.wav",
    "https://store.example.com/media/raw/a_1.wav?X-Amz-Expires=3600&X-Amz-Signature=abc": "s3://media/raw/a_1.wav",
    "https://media.s3.eu-central-1.amazonaws.com/raw/a_1.wav?X-Amz-Signature=abc": "s3://media/raw/a_1.wav",
    "/data/s3/?fileuri=s3://media/raw/a_1.wav": "s3://media/raw/a_1.wav",
    "/data/s3/?x=1&fileuri=s3%3A%2F%2Fmedia%2Fraw%2Fa_1.wav": "s3://media/raw/a_1.wav",
    "/data/s3/?fileuri=" + base64.b64encode(b"s3://media/raw/a_1.wav").decode(): "s3://media/raw/a_1.wav",
    "http://host/media//raw/./a_1.wav": "s3://media/raw/a_1.wav",
    "https://x.s3.lan/bucket/key": "s3://x/bucket/key",
}
BAD = ["/data/local-files/?d=media/a.wav", "s3://bucket-without-key", "s3://bucket/", "https://host/only-bucket", "ftp://h/a/b",
       "/data/s3/?fileuri=not*base64", "/data/s3/?fileuri=YWJj", ""]


def test_uri_shapes(spark):
    df = spark.createDataFrame([(k,) for k in [*GOOD, *BAD]], "u string")
    got = {r.u: r.n for r in df.select("u", uri.normalize_uri("u", mode="null").alias("n")).collect()}
    assert {k: got[k] for k in GOOD} == GOOD
    assert all(got[k] is None for k in BAD)


@pytest.mark.parametrize("bad", [BAD[0], BAD[1]])
def test_unknown_reference_raises(spark, bad):
    df = spark.createDataFrame([(bad,)], "u string")
    with pytest.raises(Exception, match="unrecognised audio reference"):
        df.select(uri.normalize_uri("u")).collect()


def test_split_and_name(spark):
    df = spark.createDataFrame([("s3://media/raw/a_1.wav",)], "u string")
    row = df.select(uri.split_uri("u").alias("p"), uri.file_name("u").alias("f")).first()
    assert (row.p.bucket, row.p.key, row.f) == ("media", "raw/a_1.wav", "a_1.wav")
    with pytest.raises(Exception, match="not a complete s3 reference"):
        spark.createDataFrame([("https://h/b/k",)], "u string").select(uri.split_uri("u")).collect()


def _export(spark, cells):
    rows = [(i, f"s3://media/raw/f{i}.wav", 100 + i, cell) for i, cell in enumerate(cells)]
    return spark.createDataFrame(rows, "annotation_id long, audio string, id long, label string")


def test_explode_annotations(spark):
    two = json.dumps([{"end": 2, "start": 0.5, "labels": ["a", "b"], "channel": 0}, {"end": 4, "start": 3, "labels": ["c"], "channel": 0}])
    empty_labels = json.dumps([{"start": 0, "end": 1, "labels": [], "channel": 0}])
    df = intervals.explode_annotations(_export(spark, [None, "  ", "[]", empty_labels, two]), keep_order=True)
    rows = [tuple(r) for r in df.orderBy("annotation_id", "interval_no", "label_no").collect()]
    names = ("f0.wav", "s3://media/raw/f0.wav"), ("f1.wav", "s3://media/raw/f1.wav"), ("f4.wav", "s3://media/raw/f4.wav")
    assert rows == [
        ("0", "100", 0.0, None, "background", *names[0], 0, 0),
        ("1", "101", 0.0, None, "background", *names[1], 0, 0),
        ("4", "104", 0.5, 2.0, "a", *names[2], 0, 0),
        ("4", "104", 0.5, 2.0, "b", *names[2], 0, 1),
        ("4", "104", 3.0, 4.0, "c", *names[2], 1, 0),
    ]


@pytest.mark.parametrize("cell", ["{broken", '[{"start": 0, "end": 1}]', '[{"labels": ["a"], "start": 0}]', "null"])
def test_bad_label_json_raises(spark, cell):
    with pytest.raises(Exception, match="bad label JSON in annotation"):
        intervals.explode_annotations(_export(spark, [cell])).collect()


def test_export_csv_and_annotation_csv(spark, tmp_path):
    source = tmp_path / "export.csv"
    source.write_text(
        '"annotation_id","annotator","audio","created_at","id","label","lead_time","updated_at"\n'
        '33,"1","s3://media/raw/x.wav","2024-10-28T14:47:15Z",32,"[{""end"":120,""start"":0,""labels"":[""background""],""channel"":0}]",8.614,"2024-10-28T14:47:15Z"\n'
        '34,"1","s3://media/raw/y.wav","2024-10-28T14:47:15Z",33,,1.5,"2024-10-28T14:47:15Z"\n'
    )
    rows = intervals.explode_annotations(tables.read_label_export(spark, str(source)))
    sinks.write_annotations(rows, str(tmp_path / "out"))
    back = tables.read_annotations(spark, str(tmp_path / "out")).orderBy("file_id")
    assert [tuple(r) for r in back.collect()] == [
        ("33", "32", 0.0, 120.0, "background", "x.wav", "s3://media/raw/x.wav"),
        ("34", "33", 0.0, None, "background", "y.wav", "s3://media/raw/y.wav"),
    ]
    indexed = tmp_path / "indexed.csv"
    indexed.write_text(",annotation_id,file_id,start,end,label,audio_file_name,remote_audio_path\n0,33,32,0.0,,background,x.wav,s3://m/x.wav\n")
    row = tables.read_annotations(spark, str(indexed), indexed=True).first()
    assert (row.seq, row.annotation_id, row.end) == (0, "33", None)


def test_default_annotation(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "id long")
    done = spark.createDataFrame([(2,)], "task long")
    rows = intervals.default_annotation(intervals.unannotated(tasks, done, "id", "task")).collect()
    assert [(r.id, r.start, r.end, r.channel, r.labels) for r in rows] == [(1, 0.0, 7.0, 0, ["background"])]


def test_scalars(spark):
    df = spark.createDataFrame([("background", 2.9996), ("bell_a", 4.992), (None, 0.0005)], "label string, s double")
    rows = df.select(
        scalars.binary_label("label").alias("b"), scalars.label_index("label").alias("i"), scalars.to_ms("s").alias("ms"),
        scalars.sample_offset(scalars.to_ms("s")).alias("o"),
    ).collect()
    assert [(r.b, r.i) for r in rows] == [("background", 0), ("bell", 1), ("bell", 1)]
    assert [r.ms for r in rows] == [int(x * 1000) for x in (2.9996, 4.992, 0.0005)]
    assert [r.o for r in rows] == [int(16 * int(x * 1000)) for x in (2.9996, 4.992, 0.0005)]
    first, width = scalars.frame_bounds(F.lit(250), F.lit(2250))
    assert spark.range(1).select(first, width).first() == (7, 62)
    with pytest.raises(ValueError):
        scalars.feature_column(df)
    ids = spark.range(1).select(
        scalars.augmented_id(F.lit(-5), F.lit(3), F.lit(1)), scalars.noise_id(F.lit("pool"), F.lit("clip"))
    ).first()
    assert tuple(ids) == ("aug_snr-5_3_1", "noise_pool_clip")


def test_flatten_features(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "x array<array<double>>")
    assert df.select(scalars.flatten_features(F.col("x"))).first()[0] == [1.0, 2.0, 3.0, 4.0]
    ragged = spark.createDataFrame([([[1.0, 2.0], [3.0]],)], "x array<array<double>>")
    with pytest.raises(Exception, match="differ in width"):
        ragged.select(scalars.flatten_features(F.col("x"))).collect()
