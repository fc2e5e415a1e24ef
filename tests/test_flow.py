"""From a label export and WAV files to a trained model and a scored stream."""

import datetime
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.operators import intervals, metrics, model, splitting
from sonarium.plans import training
from sonarium.session import materialize
from sonarium.sources import audio, streams, tables
from sonarium.streaming import detector, scoring

RATE = 16000


def _write(path, samples):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(1), out.setsampwidth(2), out.setframerate(RATE)
        out.writeframes(np.asarray(samples).astype("<i2").tobytes())


def _tone(seconds, rng):
    t = np.arange(int(seconds * RATE)) / RATE
    return 6000 * np.sin(2 * np.pi * 1800 * t) + rng.normal(0, 100, len(t))


def _hiss(seconds, rng):
    return rng.normal(0, 1500, int(seconds * RATE))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    root = tmp_path_factory.mktemp("flow")
    (root / "audio").mkdir(), (root / "pool").mkdir()
    lines = ['"annotation_id","annotator","audio","created_at","id","label","lead_time","updated_at"']
    for i in range(12):
        samples = np.concatenate([_hiss(3, rng), _tone(3, rng)])
        _write(root / "audio" / f"r{i}.wav", samples)
        items = json.dumps([{"start": 0, "end": 3, "labels": ["background"], "channel": 0}, {"start": 3.0, "end": 6.5, "labels": ["front"], "channel": 0}])
        cell = "" if i == 0 else '"' + items.replace('"', '""') + '"'
        lines.append(f'{i},"1","https://store.example.com/m/r{i}.wav?sig=1","t",{i},{cell},1.0,"t"')
    for i in range(6):
        _write(root / "pool" / f"n{i}.wav", _hiss(4, rng))
    (root / "export.csv").write_text("\n".join(lines) + "\n")
    real = intervals.explode_annotations(tables.read_label_export(spark, str(root / "export.csv")))
    dirs = [str(root / "audio"), str(root / "pool")]
    info = audio.audio_info(spark, dirs).withColumn("audio_file_name", F.substring_index("path", "/", -1))
    pool = intervals.pool_rows(audio.audio_info(spark, dirs[1]), F.lit("pool"))
    together = intervals.union_sources(real, pool)
    info, feats = materialize(info, "info"), materialize(training.extract_features(spark, dirs), "features")
    return materialize(training.training_table(together, info, feats), "training")


def test_balanced_table(table):
    counts = {(r.label, r.noise_pool): r["count"] for r in table.groupBy("label", "noise_pool").count().collect()}
    # r0 is whole-file background; the others give a 3 s tone, cut at the file end (5 starts, the last one inside)
    positives = 11 * len([s for s in range(3000, 4500, 250) if (s + 2000) * 16 <= 96000])
    assert counts[("front", None)] == positives
    assert counts[("background", None)] + counts[("background", "pool")] == positives
    shapes = table.select(F.size("mfcc_features").alias("c"), F.size(F.element_at("mfcc_features", 1)).alias("w")).distinct().collect()
    assert [(r.c, r.w) for r in shapes] == [(13, 62)]
    assert table.filter("split_group IS NULL").count() == 0
    metric = metrics.quality_metrics(table).first()
    assert metric.total_samples == 2 * positives and metric.imbalance_ratio == 1.0


def test_train_and_stream(spark, table, tmp_path):
    split = splitting.group_split(table.withColumn("positive", F.col("label") != "background"), "split_group", "positive")
    prepared = materialize(model.prepare(split, keep=("is_test",)), "prepared")
    fitted = model.train(prepared.filter("NOT is_test"), rounds=3, depth=2)
    assert {r.side: r.f1 for r in model.evaluate(model.predict(fitted, prepared)).collect()}["val"] > 0.9

    rng = np.random.default_rng(9)
    # 2 s chunks carry 63 frames where training windows carry 62: the misfit must not pass silently
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    size = int(RATE * 2 - 512)  # 62 frames
    line = [_hiss(2, rng)[:size] for _ in range(8)] + [_tone(2, rng)[:size] for _ in range(4)] + [_hiss(2, rng)[:size] for _ in range(4)]
    rows = [("mic", i, start + datetime.timedelta(seconds=2 * i), x.astype("<i2").tobytes()) for i, x in enumerate(line)]
    chunks = spark.createDataFrame(rows, "device_id string, seq long, ts timestamp, pcm binary")
    chunks.write.parquet(str(tmp_path / "chunks"))
    settings = detector.collector_settings(chunk_ms=2000, warm_up=2, every=1, buffer_minutes=0.2, post_seconds=4.0)
    stream = scoring.model_stream(streams.stream_chunks(spark, str(tmp_path / "chunks")), fitted, settings=settings)
    found = streams.run_to_table(stream, "model").orderBy("seq").collect()
    # detection, then blind for the post chunks
    assert [(r.seq, r.clip_from, r.clip_to) for r in found] == [(8, 3, 10), (11, 6, 13)]
    wide = chunks.withColumn("pcm", F.concat("pcm", F.lit(b"\0" * 1024).cast("binary")))
    with pytest.raises(Exception, match="model expects 806 features, got 819"):
        scoring.score_chunks(wide, fitted).collect()


def test_written_tables_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3 and shared in kept.inputFiles()[0]
