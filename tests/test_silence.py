"""Silent devices on a stream, and windows of recordings that are not there."""

import datetime
import os
import time

import pandas as pd
import pytest
from pyspark.sql import types as T

from sonarium.operators import lookups
from sonarium.sources import streams
from sonarium.streaming import silence

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
BEATS = {"a": [0, 10, 20, 100, 105, 300], "b": [0, 40, 80, 120, 160, 200, 240, 280, 320], "c": [150], "end": [1000]}
AGE = 50
SCHEMA = "device_id string, ts timestamp"


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_silences_do_not_depend_on_batches(spark, tmp_path, parts):
    rows = sorted((s, d) for d, beats in BEATS.items() for s in beats)
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        out = tmp_path / f"part{i}"
        frame = [(d, START + datetime.timedelta(seconds=s)) for s, d in rows[i : i + size]]
        spark.createDataFrame(frame, SCHEMA).coalesce(1).write.parquet(str(out))
        for file in out.glob("*.parquet"):
            file.rename(tmp_path / f"{i:03d}.parquet")
            os.utime(tmp_path / f"{i:03d}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    rows = streams.stream_files(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    found = streams.run_to_table(silence.silent_stream(rows, AGE * 1000), "silent").where("device_id <> 'end'").collect()
    zero = int(START.timestamp() * 1000)
    want = sorted(
        (d, s) for d, beats in BEATS.items() if d != "end" for s, after in zip(beats, [*beats[1:], 9999]) if after - s > AGE
    )
    assert sorted((r.device_id, (r.last_seen - zero) // 1000) for r in found) == want
    assert all(r.silent_at - r.last_seen == AGE * 1000 for r in found)


class _Handle:
    """State and timers of one device, as a stream keeps them."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_processing_clock_has_one_timer_and_one_row_a_silence():
    handle, watch = _Handle(), silence.SilenceWatch(T.StructField("device_id", T.StringType()), 50, by_event=False)
    watch.init(handle)

    def beat(now, *times):
        return [r for f in watch.handleInputRows(("a",), iter([pd.DataFrame({"ts_ms": times})]), _Clock(now)) for r in f.itertuples()]

    def fire(now):
        handle.timers = {t for t in handle.timers if t > now}
        return [tuple(r) for f in watch.handleExpiredTimer(("a",), _Clock(now), None) for r in f[["last_seen", "silent_at"]].to_numpy()]

    assert beat(1000, 7) == [] and handle.timers == {1051}
    assert beat(1040, 500, 9) == [] and handle.timers == {1091}  # the timer before is gone; gaps of a batch are no matter
    assert fire(1091) == [(500, 550)] and handle.timers == set()
    assert beat(1100, 400) == [] and handle.timers == set()  # older than the newest
    assert beat(1110, 600) == [] and handle.timers == {1161}
    with pytest.raises(ValueError):
        silence.silent_stream(None, 50, clock="wall")


def test_windows_of_missing_recordings(spark):
    audio = spark.createDataFrame([("a", 10, list(range(10))), ("empty", 0, [])], "path string, frames long, samples array<int>")
    index = spark.createDataFrame([("a", 0), ("a", 3), ("a", 7), ("a", 90), ("empty", 0), ("gone", 0), (None, 2)], "path string, start_sample long")
    with pytest.raises(Exception, match="no audio for"):
        lookups.attach_samples(index, audio, 4).collect()
    got = lookups.attach_samples(index, audio, 4, mode="null").collect()
    want = [("a", 0, [0, 1, 2, 3]), ("a", 3, [3, 4, 5, 6]), ("gone", 0, None), (None, 2, None)]
    assert sorted(((r.path, r.start_sample, r.window) for r in got), key=str) == sorted(want, key=str)
    assert len(lookups.attach_samples(index.where("path IN ('a', 'empty')"), audio, 4, known=audio.select("path")).collect()) == 2
