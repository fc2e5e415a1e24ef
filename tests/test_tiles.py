"""Recordings in tiles against whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.functions import pcm as kernels
from sonarium.operators import detect, features, tiles

LENGTHS = [1, 7, 64, 200, 1024, 1025]


def recordings(seed=0):
    rng = np.random.default_rng(seed)
    return {i: (rng.normal(size=n) * 8000).round() for i, n in enumerate(LENGTHS)}


def runs(spark, lines, sizes=(13, 1, 90)):
    """Runs of uneven lengths, in no order."""
    rows = []
    for key, line in lines.items():
        at = 0
        while at < len(line):
            n = sizes[len(rows) % len(sizes)]
            rows.append((key, at, line[at : at + n].tolist()))
            at += n
    return spark.createDataFrame(rows[::-1], "k int, start bigint, samples array<double>").repartition(4)


@pytest.mark.parametrize("width, before, after, pad", [(64, 0, 0, False), (5, 0, 12, False), (64, 70, 3, True), (2000, 16, 8, True), (1, 0, 0, False)])
def test_tiles_hold_their_samples(spark, width, before, after, pad):
    lines = recordings()
    got = {(r.k, r.tile): (r.n, r.samples) for r in tiles.cut_tiles(runs(spark, lines), "k", width, before, after, pad).collect()}
    want = {}
    for key, line in lines.items():
        for tile in range((len(line) - (not pad)) // width + 1):
            low, high = tile * width - before, (tile + 1) * width + after
            if pad:
                whole = np.concatenate([np.zeros(before), line, np.zeros(width + before + after)])
                part = whole[low + before : high + before]
                if low >= len(line):
                    continue
            else:
                part = line[max(low, 0) : high]
            want[key, tile] = (len(line), part.tolist())
    assert got == want


def test_runs_with_gaps_fail(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 3, [4.0])], "k int, start bigint, samples array<double>")
    with pytest.raises(Exception, match="gaps or overlaps"):
        tiles.cut_tiles(rows, "k", 2).collect()
    assert tiles.cut_tiles(rows.limit(0), "k", 2).count() == 0


@pytest.mark.parametrize("width", [10, 40, 100, 5000])
def test_overlap_save_equals_whole_recordings(spark, width):
    lines = recordings(1)
    template = lines[3][20:60] / 32768.0  # wider than the narrowest tiles
    got = {r.k: r.score for r in tiles.ncc_tiles(runs(spark, lines), "k", template, width, 32768.0).collect()}
    for key, line in lines.items():
        assert abs(got[key] - kernels.correlation_peak(line / 32768.0, template)) < 1e-9
    assert got[3] > 0.999 and got[0] == 0.0


@pytest.mark.parametrize("frames, n_fft, hop", [(1, 64, 16), (3, 64, 16), (7, 64, 64), (1000, 64, 16), (2, 32, 48)])
def test_mfcc_in_two_passes_equals_one(spark, frames, n_fft, hop):
    """Quiet recordings have cells under the floor, which only the loudest cell of all tiles tells."""
    lines = {k: v * np.where(np.arange(len(v)) < len(v) // 2, 1e-5, 1.0) for k, v in recordings(2).items()}
    whole = spark.createDataFrame([(k, 16000, v.tolist()) for k, v in lines.items()], "k int, rate int, samples array<double>")
    want = {r.k: np.array(r.mfcc_features) for r in features.mfcc(whole, 5, n_fft, hop, n_mels=12, double=True).collect()}
    got = tiles.mfcc_tiles(runs(spark, lines), "k", 16000, 5, n_fft, hop, 12, frames).collect()
    assert len(got) == sum(w.shape[1] for w in want.values())
    for r in got:
        assert np.allclose(r.coefficients, want[r.k][:, r.frame_no], atol=1e-8)


def test_trim_keeps_the_first_of_equal_runs(spark):
    lines = [[0.0] * 10 + [3.0] * 40 + [0.0] * 10 + [3.0] * 40, [1.0] * 30, [], [2.0] * 31, None]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, x array<double>")
    got = {r.k: r for r in detect.energetic_window(df, "k", "x", 30).collect()}
    assert [(got[i].start, got[i].stop) for i in range(5)] == [(10, 40), (0, 30), (0, 0), (0, 30), (None, None)]
    assert got[0].window == [0.0, 1.5, 3.0] + [3.0] * 24 + [3.0, 1.5, 0.0]  # fades over a tenth
    assert got[1].window == [1.0] * 30 and got[4].window is None
    plan = detect.energetic_window(df, "k", "x", 30)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
