"""Correlation, template trimming, cooldown and clips against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.functions import pcm as kernels
from sonarium.operators import detect, lookups


def _score(audio, template):
    return kernels.correlation_peak(np.asarray(audio, dtype=np.int16) / 32768.0, template)


def test_correlation_cases():
    ones = np.ones(8000, dtype=np.float32)
    assert _score(np.zeros(8000), ones) == 0.0 and isinstance(_score(np.zeros(8000), ones), float)
    assert _score(ones * 16384, ones) > 0.5
    assert _score(np.ones(100), ones) == 0.0 and _score(np.ones(8000), ones * 0) == 0.0
    rng = np.random.default_rng(42)
    quiet = (rng.uniform(-1, 1, 8000) * 0.02).astype(np.float32)
    assert _score(rng.uniform(-1, 1, 8000) * 30000, quiet) <= 1.0
    assert 0.9 < _score(quiet * 20 * 32768, quiet) <= 1.01
    template = (rng.uniform(-1, 1, 8000) * 0.5).astype(np.float32)
    window = np.zeros(32000)
    window[12000:20000] = template
    assert _score(window * 32767, template) > 0.9
    assert _score(rng.uniform(-1, 1, 32000) * 30000, template) < 0.3


def test_correlation_equals_plain_sums():
    rng = np.random.default_rng(1)
    audio, template = rng.normal(size=300), rng.normal(size=40)
    best = max(abs(audio[i : i + 40] @ template) / np.sqrt((audio[i : i + 40] ** 2).sum() * (template**2).sum()) for i in range(261))
    assert kernels.correlation_peak(audio, template) == pytest.approx(best)
    mixed = [audio[:100], audio, audio[:10], audio * 0, *[rng.normal(size=100) for _ in range(70)]]
    together = kernels.correlation_peaks(mixed, template)
    assert np.allclose(together, [kernels.correlation_peak(x, template) for x in mixed])
    assert together[2] == together[3] == 0.0


def test_energetic_window(spark):
    burst = np.zeros(24000, dtype=np.float32)
    burst[16000:20000] = 1.0
    rows = [(0, np.ones(4000)), (1, np.ones(8000)), (2, burst), (3, np.ones(160000))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "id int, samples array<double>")
    got = {r.id: r for r in detect.energetic_window(df.filter("id < 2"), "id", "samples", 8000).collect()}
    assert [(got[i].start, got[i].stop, len(got[i].window)) for i in (0, 1)] == [(0, 4000, 4000), (0, 8000, 8000)]
    row = detect.energetic_window(df.filter("id = 2"), "id", "samples", 4000).first()
    assert (row.start, row.stop, len(row.window)) == (16000, 20000, 4000)
    row = detect.energetic_window(df.filter("id = 3"), "id", "samples", 8000).first()
    assert row.stop - row.start == 8000 and len(row.window) == 8000
    ramp = np.linspace(0, 1, 80, dtype=np.float32)
    assert np.allclose(row.window[:80], ramp) and np.allclose(row.window[-80:], ramp[::-1]) and set(row.window[80:-80]) == {1.0}


def test_udf_scores(spark):
    rng = np.random.default_rng(4)
    template = (rng.uniform(-1, 1, 400) * 0.5).astype(np.float32)
    ring = np.zeros(1600)
    ring[300:700] = template
    noise = rng.uniform(-1, 1, 1600) * 0.9
    rows = [("ring", (ring * 32767).astype("<i2").tobytes()), ("noise", (noise * 32767).astype("<i2").tobytes()), ("none", b"")]
    df = spark.createDataFrame(rows, "id string, pcm binary")
    got = {r.id: r for r in df.select("id", detect.ncc_udf(template)("pcm").alias("s"), detect.rms_udf()("pcm").alias("e")).collect()}
    assert got["ring"].s > 0.95 and got["noise"].s < 0.4 and got["none"].s == 0.0
    assert got["noise"].e == pytest.approx(np.sqrt(np.mean(noise**2)), abs=1e-3) and got["none"].e == 0.0
    best = {r.id: r.template for r in detect.multi_template_score(df, "pcm", {"a": rng.normal(size=400).tolist(), "b": template.tolist()}).collect()}
    assert best["ring"] == "b"


def _accept(times, gap):
    kept, last = [], None
    for t, i in sorted(times):
        if last is None or t - last >= gap:
            kept.append(i)
            last = t
    return kept


@pytest.mark.parametrize("gap,width", [(10, 10), (10, 3), (10, 25), (10, 100000), (0, 50), (37, 41)])
def test_cooldown_equals_loop(spark, gap, width):
    rng = random.Random(gap * 1000 + width)
    rows = []
    for key in range(4):
        t = 0
        for _ in range(600 if key == 0 else 60):
            t += rng.choice([0, 1, 1, 2, 3, 5, 60]) if key else rng.choice([0, 1, 2])
            rows.append((len(rows), key, t))
    df = spark.createDataFrame(rows, "id int, k int, t long")
    got = sorted(r.id for r in detect.cooldown(df, "k", "t", gap, "id", width).collect())
    want = sorted(i for key in range(4) for i in _accept([(t, i) for i, k, t in rows if k == key], gap))
    assert got == want


def test_detections_example(spark):
    df = spark.createDataFrame([(i, 1, int(t * 1000), 0.7) for i, t in enumerate((0, 5, 10, 19.5, 21))], "id int, k int, t long, score double")
    assert sorted(r.id for r in detect.detections(df, "k", "t", "id", 0.7, 10_000).collect()) == [0, 2, 4]
    assert detect.detections(df, "k", "t", "id", 0.7, 10_000, inclusive=False).count() == 0


def test_clips(spark):
    chunks = spark.createDataFrame([("d", i, bytes([i])) for i in range(100)], "device_id string, seq long, pcm binary")
    found = spark.createDataFrame([("d", 3), ("d", 50), ("d", 95)], "device_id string, trigger_seq long")
    context = lookups.clip_context(found, chunks, 6, 12, width=18)
    clips = {r.trigger_seq: r for r in lookups.assemble_clips(context).collect()}
    for at in (3, 50, 95):
        want = [i for i in range(at - 5, at + 13) if 0 <= i < 100]
        assert [b[0] for b in clips[at].frames] == want
        assert (clips[at].n_pre, clips[at].n_post) == (len([i for i in want if i <= at]), len([i for i in want if i > at]))


def test_analysis_windows(spark):
    seqs = [*range(0, 40), *range(43, 60)]
    chunks = spark.createDataFrame([("d", i, bytes([i])) for i in seqs], "device_id string, seq long, pcm binary")
    got = {r.seq: list(r.window) for r in detect.analysis_windows(chunks, 4, width=8).collect()}
    assert got == {i: [j for j in seqs if i - 3 <= j <= i] for i in seqs}


def test_votes_staleness_and_uncertain(spark):
    df = spark.createDataFrame([("a", 0.9, 10), ("a", 0.45, 90), ("b", 0.2, 40), ("b", 0.6, 50)], "clip string, p double, t long")
    votes = {r.clip: r.detected for r in detect.k_of_n_vote(df, "clip", F.col("p") > 0.5, 2).collect()}
    assert votes == {"a": False, "b": False}
    assert all(r.detected for r in detect.k_of_n_vote(df, "clip", F.col("p") > 0.5).collect())
    assert [r.clip for r in detect.stale_devices(df, "clip", "t", F.lit(100), 30).collect()] == ["b"]
    assert [r.p for r in detect.uncertain_rows(df, "p").collect()] == [0.45]


def test_first_of_equally_energetic_runs(spark):
    """Runs of the same values in another order, behind loud ones that leave no digits for them in a double's sum."""
    values = [1e6 + 0.1] * 3 + [0.0] * 40 + [1e6 + 0.3, 300.7, 12.34, 0.01] * 50
    rows = [(1, i + 1, v) for i, v in enumerate(values)]
    row = detect.energetic_series(spark.createDataFrame(rows, "k long, seq long, v double"), "k", "seq", "v", 4, digits=6).first()
    squares = [round(v * v * 10**6) for v in values]
    sums = [sum(squares[i : i + 4]) for i in range(len(values) - 3)]
    assert (row.start, row.stop) == (sums.index(max(sums)), sums.index(max(sums)) + 4)
    again = [(1, i + 1, v) for i, v in enumerate([7e7, 0.0, 0.0, 0.0] + [41.17, 0.3, 17.29, 490.02] * 400)]
    frame = spark.createDataFrame(again, "k long, seq long, v double").where("seq > 1").withColumn("seq", F.col("seq") - 1)
    row = detect.energetic_series(frame, "k", "seq", "v", 4, digits=6).first()
    assert (row.start, row.stop) == (3, 7)
