"""Sliding windows, window indexes and ordered per-key computations."""

import random

import pytest
from pyspark.sql import functions as F

from sonarium.operators import intervals, ordered


@pytest.mark.parametrize("length,expected", [(1999, 0), (2000, 0), (2001, 1), (2250, 1), (2251, 2), (5000, 12), (300000, 1192)])
def test_slide_counts(spark, length, expected):
    df = spark.createDataFrame([(500, 500 + length)], "start_ms long, end_ms long")
    got = [r.chunk_start for r in intervals.slide_windows(df, 2000, 250).orderBy("chunk_start").collect()]
    assert got == list(range(500, 500 + length - 2000, 250)) and len(got) == expected


def test_slide_block_borders_and_options(spark):
    n = intervals.WINDOW_BLOCK * 2 + 5
    df = spark.createDataFrame([(1, 0, n), (2, 0, None), (3, 10, 5)], "id int, start_ms long, end_ms long")
    out = intervals.slide_windows(df, 1, 1, spread=3)
    assert out.count() == n - 1
    assert out.select("chunk_start").distinct().count() == n - 1
    assert intervals.slide_windows(df, 1, 1, include_last=True).count() == n


def test_annotation_to_windows(spark):
    rows = [(0.0, 120.0, "background"), (1.25, 4.992, "bell"), (0.0, 2.0, "bell")]
    df = intervals.with_bounds(spark.createDataFrame(rows, "start double, end double, label string"))
    got = {r.label: r.n for r in intervals.slide_windows(df, 2000, 250).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"background": len(range(0, 118000, 250)), "bell": len(range(1250, 2992, 250))}


@pytest.mark.parametrize("rate", [16000, 44100, 11025])
def test_index_windows_matches_loop(spark, rate):
    rng = random.Random(rate)
    rows = [(i, rng.randrange(0, 5000), rng.randrange(0, 9000), rate, rng.randrange(1000, rate * 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, start_ms long, end_ms long, rate int, frames long")
    got = sorted((r.id, r.start_sample, r.length) for r in intervals.index_windows(df, 700, 90).collect())
    want = []
    per_ms = rate / 1000
    for i, start, end, _, frames in rows:
        for at in range(start, end - 700, 90):
            if int(per_ms * at) + int(per_ms * 700) <= frames:
                want.append((i, int(per_ms * at), int(per_ms * 700)))
    assert got == sorted(want)


def test_index_pool(spark):
    info = spark.createDataFrame([("clip.wav", 16000, 80000), ("short.wav", 16000, 32000)], "path string, rate int, frames long")
    rows = intervals.index_pool(info, 2000, 250).orderBy("start_sample").collect()
    assert len(rows) == 12 and rows[-1].start_sample == 44000 and rows[-1].length == 32000


def _events(spark, n=400, keys=4, seed=1):
    rng = random.Random(seed)
    # key 0 holds most rows
    rows = [(i, 0 if rng.random() < 0.7 else rng.randrange(1, keys), rng.randrange(0, 5000), rng.random() < 0.1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, k int, t long, reset boolean")


@pytest.mark.parametrize("width", [1, 37, 1000, 10**6])
def test_ordinal_next_and_sessions(spark, width):
    rows, df = _events(spark)
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(r[1], []).append(r)
    place, follow, sessions = {}, {}, {}
    for items in by_key.values():
        session = position = 0
        for i, r in enumerate(items):
            place[r[0]] = i + 1
            follow[r[0]] = items[i + 1][2] if i + 1 < len(items) else None
            session, position = (session + 1, 1) if r[3] else (session, position + 1)
            sessions[r[0]] = (session, position)
    assert {r.id: r.ordinal for r in ordered.with_ordinal(df, ["k"], ["t", "id"], width).collect()} == place
    nxt = ordered.with_next(df, ["k"], ["t", "id"], width, "t", "next")
    assert {r.id: r.next for r in nxt.collect()} == follow
    sess = ordered.with_session_position(df, ["k"], ["t", "id"], width, F.col("reset"))
    assert {r.id: (r.session, r.position) for r in sess.collect()} == sessions
    kept = ordered.throttle(ordered.warm_up(df, ["k"], ["t", "id"], width, 2, F.col("reset")), 3, skipped=2)
    assert {r.id for r in kept.collect()} == {i for i, (_, p) in sessions.items() if p > 2 and (p - 2) % 3 == 0}


@pytest.mark.parametrize("width", [5, 64])
def test_rolling(spark, width):
    values = [(1, i + 1, float((i * 7) % 13)) for i in range(100)] + [(2, 1, 4.0), (2, 2, 5.0)]
    df = spark.createDataFrame(values, "k int, seq long, v double")
    back = {(r.k, r.seq): r.c for r in ordered.rolling_context(df, ["k"], "seq", "v", 2.0, 0.5, "c", width).collect()}
    ahead = {(r.k, r.seq): r.c for r in ordered.rolling_list(df, ["k"], "seq", "v", 4, "c", width, ahead=True).collect()}
    energy = {(r.k, r.seq): r.energy for r in ordered.rolling_energy(df, ["k"], "seq", "v", 4, width=width).collect()}
    for k in (1, 2):
        line = [v for key, _, v in values if key == k]
        for i in range(len(line)):
            assert back[k, i + 1] == line[max(0, i - 3) : i + 1]
            assert ahead[k, i + 1] == line[i : i + 4]
            whole = line[i : i + 4]
            want = sum(v * v for v in whole) if len(whole) == 4 else None
            assert energy[k, i + 1] == (pytest.approx(want) if want is not None else None)
