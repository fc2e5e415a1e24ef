"""The stream state machine over several micro-batches against a plain loop."""

import datetime
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.operators import detect, lookups
from sonarium.sources import audio, sinks, streams
from sonarium.streaming import detector, reorder, ring

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def _write(spark, folder, rows, schema, parts):
    """One file per micro-batch, with increasing modification times."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        out = folder / f"batch{i}"
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(str(out))
        for file in out.glob("*.parquet"):
            target = folder / f"{i:03d}.parquet"
            file.rename(target)
            os.utime(target, (time.time() - 1000 + i, time.time() - 1000 + i))
    return str(folder)


CHUNKS = "device_id string, seq long, ts timestamp, pcm binary"
TRIGGERS = "device_id string, ts timestamp, source string, payload string"


def _chunks(device, values, seqs=None):
    seqs = list(seqs if seqs is not None else range(len(values)))
    return [(device, s, START + datetime.timedelta(milliseconds=500 * s), v) for s, v in zip(seqs, values)]


def _audio(n, rings, length=400, seed=0):
    """Noise chunks with the template written across chunk borders at the given sample positions."""
    rng = np.random.default_rng(seed)
    template = rng.uniform(-1, 1, length) * 0.5
    line = rng.uniform(-1, 1, n * length) * 0.01
    for at in rings:
        line[at : at + length] = template
    pcm = (line * 32767).astype("<i2")
    return template.astype(np.float32), [pcm[i * length : (i + 1) * length].tobytes() for i in range(n)]


def _run(spark, tmp_path, rows, settings, triggers=None, parts=4, name="d"):
    folder = tmp_path / name
    folder.mkdir()
    source = streams.stream_chunks(spark, _write(spark, folder, rows, CHUNKS, parts), files_per_trigger=1)
    marks = None
    if triggers:
        trigger_folder = tmp_path / (name + "_t")
        trigger_folder.mkdir()
        marks = streams.stream_triggers(spark, _write(spark, trigger_folder, triggers, TRIGGERS, 1), expected="go")
    table = streams.run_to_table(detector.detect_stream(source, settings, marks), name, idle=False)
    return [(r.device_id, r.seq, r.source, r.clip_from, r.clip_to) for r in table.orderBy("device_id", "seq").collect()]


def test_template_detector_equals_batch(spark, tmp_path):
    # second ring straddles two chunks, third falls into the cooldown of the second
    template, values = _audio(120, [4000, 16200, 18000, 30000])
    rows = _chunks("mic", values)
    settings = detector.DetectorSettings(template=template.tolist(), threshold=0.7, cooldown_ms=10_000, save=False)
    got = _run(spark, tmp_path, rows + rows[5:9], settings, parts=5)
    chunks = spark.createDataFrame(rows, CHUNKS)
    scored = detect.analysis_windows(chunks, 4).select(
        "device_id", "seq", F.unix_millis("ts").alias("ms"), detect.ncc_udf(template)("window").alias("score")
    )
    batch = detect.detections(scored, "device_id", "ms", "seq", 0.7, 10_000)
    want = sorted(("mic", r.seq, "ncc", None, None) for r in batch.collect())
    assert got == want and [g[1] for g in got] == [10, 41, 75]


def _loop(rows, settings, triggers):
    """The state machine over one device's scored rows, as a plain loop."""
    found, blind, accepted, warm, counted, last, first = [], None, None, settings.warm_up, 0, None, None
    pending = sorted(triggers)
    fired = False
    for seq, ms, score in rows:
        while pending and pending[0] <= ms:
            pending.pop(0)
            fired = True
        if last is not None and seq > last + 1:
            warm, counted, first = settings.warm_up, 0, None if settings.warm_up else first
        last = seq
        inside = blind is not None and seq <= blind
        if warm and not inside:
            warm -= 1
            continue
        first = seq if first is None else first
        if inside:
            continue
        source = None
        if fired:
            fired = False
            if not settings.save:
                continue
            source = "manual"
        else:
            counted += 1
            if counted % settings.every:
                continue
            good = score >= settings.threshold if settings.inclusive else score > settings.threshold
            if good and (accepted is None or ms - accepted >= settings.cooldown_ms):
                accepted, source = ms, settings.scorer
        if source:
            ends = (max(first, seq - settings.pre_chunks + 1), seq + settings.post_chunks) if settings.save else (None, None)
            blind = ends[1] if settings.save else blind
            found.append((seq, source, *ends))
    return found


@pytest.mark.parametrize("save", [True, False])
def test_state_machine_equals_loop(spark, tmp_path, save):
    rng = np.random.default_rng(8)
    settings = detector.DetectorSettings(
        scorer="given", threshold=0.8, cooldown_ms=6000, pre_chunks=6, post_chunks=5, save=save, warm_up=3, every=2
    )
    seqs = [s for s in range(300) if s not in (50, 51, 120)]
    scores = {s: float(rng.uniform()) for s in seqs}
    rows = [("a", s, START + datetime.timedelta(milliseconds=500 * s), scores[s]) for s in seqs]
    marks = [20_250, 20_400, 80_000, 100_000]
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "device_id string, seq long, ts timestamp, score double"
    path = _write(spark, folder, rows, schema, 6)
    tfolder = tmp_path / "t"
    tfolder.mkdir()
    stamps = [("a", START + datetime.timedelta(milliseconds=m), "topic", " go ") for m in marks]
    stamps += [("a", START, "topic", "other")]
    tpath = _write(spark, tfolder, stamps, TRIGGERS, 1)
    # triggers share the chunk stream's clock: run both in one batch so that they line up
    source = streams.stream_files(spark, path, spark.createDataFrame([], schema).schema)
    out = detector.detect_stream(source, settings, streams.stream_triggers(spark, tpath, "go"))
    got = [(r.seq, r.source, r.clip_from, r.clip_to) for r in streams.run_to_table(out, "machine").orderBy("seq").collect()]
    line = [(s, int(START.timestamp() * 1000) + 500 * s, scores[s]) for s in seqs]
    want = _loop(line, settings, [int(START.timestamp() * 1000) + m for m in marks])
    assert got == want and len(want) > 3
    # the same rows over six micro-batches, without triggers
    staged = streams.stream_files(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = streams.run_to_table(detector.detect_stream(staged, settings), "staged").orderBy("seq").collect()
    assert [(r.seq, r.source, r.clip_from, r.clip_to) for r in got] == _loop(line, settings, [])


def test_energy_trigger_clip_and_events(spark, tmp_path):
    loud, soft = np.full(400, 12000, "<i2").tobytes(), np.full(400, 20, "<i2").tobytes()
    values = [soft] * 30 + [loud] * 2 + [soft] * 30
    settings = detector.DetectorSettings(scorer="energy", threshold=0.15, pre_chunks=6, post_chunks=12)
    found = _run(spark, tmp_path, _chunks("mic", values), settings, parts=3)
    assert [(f[1], f[2]) for f in found] == [(30, "energy")] and found[0][3:] == (25, 42)
    chunks = spark.createDataFrame(_chunks("mic", values), CHUNKS)
    triggers = spark.createDataFrame([("mic", 30)], "device_id string, trigger_seq long")
    clip = lookups.assemble_clips(lookups.clip_context(triggers, chunks, 6, 12)).first()
    assert (clip.n_pre, clip.n_post) == (6, 12)
    stored = spark.createDataFrame(_chunks("mic", values), CHUNKS)
    rows = spark.createDataFrame(found, "device_id string, seq long, source string, clip_from long, clip_to long")
    sinks.save_clips(rows, stored, str(tmp_path / "clips"), str(tmp_path / "log"))
    written = audio.scan_audio(spark, str(tmp_path / "clips")).first()
    assert written.path.endswith("clip_mic_30.wav") and written.frames == 18 * 400
    assert written.samples == np.frombuffer(b"".join(values[25:43]), "<i2").tolist()
    events = spark.createDataFrame([("mic", 30, START, 0.9, "ncc")], "device_id string, seq long, ts timestamp, score double, source string")
    row = sinks.detection_events(events).first()
    assert row.key == "mic" and '"detected_at":"2024-01-01T00:00:00.000000"' in row.value


def test_emit_to_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("mic", i, START + datetime.timedelta(seconds=i), float(i % 5 == 0)) for i in range(20)]
    schema = "device_id string, seq long, ts timestamp, score double"
    path = _write(spark, tmp_path / "in", rows, schema, 1)
    source = streams.stream_files(spark, path, spark.createDataFrame([], schema).schema)
    found = detector.detect_stream(source, detector.DetectorSettings(scorer="given", cooldown_ms=10_000, save=False))
    query = sinks.emit_detections(found, str(tmp_path / "cp"), sink="json", path=str(tmp_path / "out"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert len(got) == 2 and {r.key for r in got} == {"mic"}
    assert any('"seq":10' in r.value and '"detected_at":"2024-01-01T00:00:10.000000"' in r.value for r in got)


def test_settings():
    d = detector.detector_settings()
    assert (d.analysis_chunks, d.pre_chunks, d.post_chunks, d.inclusive, d.every) == (4, 6, 12, True, 1)
    c = detector.collector_settings()
    assert (c.pre_chunks, c.post_chunks, c.warm_up, c.every, c.inclusive, c.cooldown_ms) == (600, 14, 10, 3, False, 0)


def test_trigger_matching(spark):
    df = spark.createDataFrame([(" go ",), ("stop",)], "p string")
    assert df.filter(streams.match_trigger(F.col("p"), "go")).count() == 1
    assert df.filter(streams.match_trigger(F.col("p"), None)).count() == 2


def test_throttle_over_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("ab"[int(rng.uniform() < 0.2)], i, 1000 * i, bool(rng.uniform() < 0.1)) for i in range(200)]
    folder = tmp_path / "rows"
    folder.mkdir()
    schema = "device_id string, row_id long, ts_ms long, is_reset boolean"
    path = _write(spark, folder, rows, schema, 5)
    source = streams.stream_files(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = {r.row_id for r in streams.run_to_table(detector.throttle_stream(source, 2, 3), "thr").collect()}
    want, place = set(), {}
    for device, i, _, reset in rows:
        place[device] = 1 if reset else place.get(device, 0) + 1
        if place[device] > 2 and (place[device] - 2) % 3 == 0:
            want.add(i)
    assert got == want


def _arrive(spark, tmp_path, name, rows, parts, **options):
    folder = tmp_path / name
    folder.mkdir()
    schema = "device_id string, seq long, ts timestamp, score double, note string"
    path = _write(spark, folder, rows, schema, parts)
    source = streams.stream_files(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    return reorder.reorder_stream(source, 10_000, **options)


def _moment(ms):
    return START + datetime.timedelta(milliseconds=ms)


@pytest.mark.parametrize("parts", [1, 7])
def test_shuffled_chunks_stand_in_order(spark, tmp_path, parts):
    """Whatever the micro-batches, chunks at most the delay late come out once, in order, none late."""
    rng = np.random.default_rng(parts)
    rows = [(d, s, _moment(500 * s + k), float(s), None if s % 3 else "x") for k, d in enumerate("ab") for s in range(120)]
    shifted = sorted(rows + rows[5:9], key=lambda r: r[2] + datetime.timedelta(milliseconds=int(rng.integers(0, 9_900))))
    tick = [("z", 0, _moment(10_000_000), None, None)]
    got = streams.run_to_table(_arrive(spark, tmp_path, "in", shifted + tick, parts), "order").where("device_id <> 'z'").collect()
    start = int(START.timestamp() * 1000)
    want = {(d, start + 500 * s + k, s, float(s), None if s % 3 else "x", s + 1, False) for k, d in enumerate("ab") for s in range(120)}
    assert len(got) == 240 and {tuple(r) for r in got} == want


def test_late_chunks_are_counted(spark, tmp_path):
    """Too late is what belongs before a released chunk; what the watermark has passed without that still goes in order."""
    rows = [("a", s, _moment(500 * s), 0.0, "first") for s in (0, 1, 2, 5)]
    rows += [("z", 0, _moment(100_000), None, None)] * 4  # the watermark passes all of them
    rows += [("z", 1, _moment(100_000), None, None)] * 4  # they are released with the next batch
    rows += [("a", 3, _moment(1500), 0.0, "late"), ("a", 7, _moment(3500), 0.0, "in order"), ("b", 1, _moment(0), 0.0, "new device"), ("a", 5, _moment(2500), 0.0, "again")]
    rows += [("z", 2, _moment(200_000), None, None)] * 4
    got = streams.run_to_table(_arrive(spark, tmp_path, "in", rows, 5), "late").where("device_id <> 'z'").collect()
    assert {(r.device_id, r.seq, r.position, r.late) for r in got} == {
        ("a", 0, 1, False), ("a", 1, 2, False), ("a", 2, 3, False), ("a", 5, 4, False),
        ("a", 3, None, True), ("a", 5, None, True), ("a", 7, 5, False), ("b", 1, 1, False),
    }


def test_detector_behind_the_buffer(spark, tmp_path):
    """Shuffled arrival gives the detections of arrival in order, over one and over many micro-batches."""
    rng = np.random.default_rng(12)
    rows = [("mic", s, _moment(500 * s), float(rng.uniform()), None) for s in range(200)]
    settings = detector.DetectorSettings(scorer="given", threshold=0.7, cooldown_ms=4000, save=False)
    want = [r[0] for r in _loop([(s, 500 * s, score) for _, s, _, score, _ in rows], settings, [])]
    shifted = sorted(rows, key=lambda r: r[2] + datetime.timedelta(milliseconds=int(rng.integers(0, 9_900))))
    for parts in (1, 6):
        ordered = _arrive(spark, tmp_path, f"in{parts}", shifted + [("z", 0, _moment(10_000_000), None, None)], parts)
        chunks = ordered.where("NOT late").select("device_id", "seq", F.timestamp_millis("ts_ms").alias("ts"), "score")
        found = streams.run_to_table(detector.detect_stream(chunks, settings), f"behind{parts}").orderBy("seq").collect()
        assert [r.seq for r in found if r.device_id == "mic"] == want and len(want) > 5


def test_devices_share_buckets(spark, tmp_path):
    """Two buckets of forty devices: each device has its own order, positions and cooldown."""
    rng = np.random.default_rng(8)
    rows = [(f"d{d}", s, _moment(500 * s), float(rng.uniform()), None) for s in range(30) for d in range(40)]
    shifted = sorted(rows, key=lambda r: r[2] + datetime.timedelta(milliseconds=int(rng.integers(0, 9_900))))
    source = _arrive(spark, tmp_path, "in", shifted + [("z", 0, _moment(10_000_000), None, None)], 3, buckets=2)
    chunks = source.where("NOT late AND position = seq + 1").select("device_id", "seq", F.timestamp_millis("ts_ms").alias("ts"), "score")
    settings = detector.DetectorSettings(scorer="given", threshold=0.7, cooldown_ms=4000, save=False)
    found = streams.run_to_table(detector.detect_stream(chunks, settings, buckets=2), "shared").collect()
    want = set()
    for d in range(40):
        mine = [(s, 500 * s, score) for name, s, _, score, _ in rows if name == f"d{d}"]
        want |= {(f"d{d}", r[0]) for r in _loop(mine, settings, [])}
    assert {(r.device_id, r.seq) for r in found if r.device_id != "z"} == want and len(found) >= len(want) > 40


def test_reordering_refuses_names_in_use(spark):
    with pytest.raises(ValueError, match="late"):
        reorder.reorder_stream(spark.createDataFrame([], "device_id string, seq long, ts timestamp, late boolean"), 1000)


def test_ring_starts_anew_at_gaps_and_resets(spark, tmp_path):
    schema = "device_id string, seq long, ts timestamp, pcm binary, is_reset boolean"
    rows = [("a", s, _moment(500 * i), bytes([s]), r) for i, (s, r) in enumerate([(1, False), (2, False), (3, False), (6, False), (7, False), (1, True), (2, False), (2, False)])]
    (tmp_path / "in").mkdir()
    path = _write(spark, tmp_path / "in", rows, schema, 4)
    source = streams.stream_files(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = streams.run_to_table(ring.analysis_stream(source, 3), "ring", idle=False).orderBy("ts").collect()
    assert [None if r.window is None else list(r.window) for r in got] == [[1], [1, 2], [1, 2, 3], [6], [6, 7], [1], [1, 2], None]


def test_late_chunks_of_the_detector_are_reported(spark, tmp_path):
    _, values = _audio(20, [])
    rows = _chunks("mic", values)
    settings = detector.DetectorSettings(scorer="energy", threshold=2.0, save=False, report_late=True)
    assert [(f[1], f[2]) for f in _run(spark, tmp_path, rows + rows[5:9], settings, parts=3)] == [(s, "late") for s in range(5, 9)]


def test_silent_device_loses_its_ring(spark, tmp_path):
    """After the time to live the store gives an empty ring: the next window holds its own chunk only."""
    schema = "device_id string, seq long, ts timestamp, pcm binary"
    rows = [("a", s, _moment(500 * s), bytes([s])) for s in (1, 2, 3)]
    folder = tmp_path / "in"
    folder.mkdir()
    path = _write(spark, folder, rows[:2], schema, 1)
    source = streams.stream_files(spark, path, spark.createDataFrame([], schema).schema)

    def later():
        time.sleep(1.5)
        spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(path)

    got = streams.run_to_table(ring.analysis_stream(source, 3, ttl_ms=1000), "ttl", close=later, idle=False).orderBy("seq").collect()
    assert [list(r.window) for r in got] == [[1], [1, 2], [3]]
