"""Stateful detection over chunk streams: one small state machine per device, fed with scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sonarium.operators.detect import ncc_udf, rms_udf
from sonarium.streaming.ring import RING_TTL_MS, analysis_stream


@dataclass(frozen=True)
class DetectorSettings:
    """``scorer='ncc'`` compares windows of chunks with ``template``, ``'energy'`` takes their loudness, ``'given'`` reads
    ``score``. With ``report_late`` a chunk that comes after a newer one gives a row of source ``late``."""

    scorer: str = "ncc"
    template: Sequence[float] | None = None
    threshold: float = 0.7
    inclusive: bool = True
    cooldown_ms: int = 10_000
    analysis_chunks: int = 4
    pre_chunks: int = 6
    post_chunks: int = 12
    save: bool = True
    warm_up: int = 0
    every: int = 1
    scoring: bool = True
    report_late: bool = False
    ring_ttl_ms: int = RING_TTL_MS


def detector_settings(chunk_ms: int = 500, window_s: float = 2.0, buffer_minutes: float = 0.05,
                      post_seconds: float = 6.0, **kwargs) -> DetectorSettings:
    """Chunk counts of the template detector from times."""
    chunk_s = chunk_ms / 1000.0
    return DetectorSettings(
        analysis_chunks=max(1, round(window_s / chunk_s)),
        pre_chunks=max(1, int(buffer_minutes * 60 / chunk_s)),
        post_chunks=max(1, int(post_seconds / chunk_s)),
        **kwargs,
    )


def collector_settings(chunk_ms: int = 500, buffer_minutes: float = 5.0, post_seconds: float = 7.0,
                       rate: int = 16000, **kwargs) -> DetectorSettings:
    """Chunk counts of the model detector: warm-up of 10, every third chunk, strict threshold, no cooldown."""
    chunk = int(rate * chunk_ms / 1000)
    defaults = dict(scorer="given", threshold=0.5, inclusive=False, cooldown_ms=0, warm_up=10, every=3, analysis_chunks=1)
    return DetectorSettings(
        pre_chunks=max(1, int(buffer_minutes * 60 / (chunk_ms / 1000.0))),
        post_chunks=int(rate * post_seconds / chunk),
        **{**defaults, **kwargs},
    )


#: What is known of a device.
POSITION = [
    T.StructField(name, kind)
    for name, kind in (
        ("last_seq", T.LongType()), ("accepted_ms", T.LongType()), ("blind_until", T.LongType()), ("first_seq", T.LongType()),
        ("warm_left", T.IntegerType()), ("counted", T.IntegerType()), ("triggered", T.BooleanType()),
    )
]
#: Devices share state in so many buckets: a call to the state costs far more than a chunk.
BUCKETS = 128


def _events_type(key_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("device_id", key_type),
            T.StructField("seq", T.LongType()),
            T.StructField("ts_ms", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("source", T.StringType()),
            T.StructField("clip_from", T.LongType()),
            T.StructField("clip_to", T.LongType()),
        ]
    )


class ChunkDetector(StatefulProcessor):
    """Warm-up, manual triggers, threshold, cooldown and clip bounds over scored chunks, for a bucket of devices.

    Emits one row per detection or manual trigger. A clip is named by its chunk numbers
    ``clip_from..clip_to``; its bytes are joined from the stored chunks, so state holds a few numbers for each device and
    no sound. After a saved event the device is blind for the post chunks.
    """

    def __init__(self, settings: DetectorSettings, key_type: T.DataType):
        self.settings, self.key_type = settings, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        devices = T.ArrayType(T.StructType([T.StructField("device_id", self.key_type), *POSITION]))
        self.positions = handle.getValueState("positions", T.StructType([T.StructField("devices", devices)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one bucket in one micro-batch: bounded by the source's rate limit
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(["ts_ms", "is_trigger", "seq"], ascending=[True, False, True])
        stored = self.positions.get()
        positions = {device: place for device, *place in stored[0]} if stored else {}
        found = []
        for device, *row in zip(*[batch[n] for n in ("device_id", "seq", "ts_ms", "score", "is_trigger", "is_reset")]):
            # rows without a device have a bucket of their own
            device = None if key[0] is None else device
            known = positions.get(device) or (None, None, None, None, self.settings.warm_up, 0, False)
            positions[device], event = self._step(known, *row)
            if event:
                found.append((device, *event))
        self.positions.update(([(device, *place) for device, place in positions.items()],))
        frame = pd.DataFrame(found, columns=["device_id", "seq", "ts_ms", "score", "source", "clip_from", "clip_to"])
        yield frame.astype({"seq": "int64", "ts_ms": "int64", "score": "float64", "clip_from": "Int64", "clip_to": "Int64"})

    def _step(self, known: Sequence, seq: int, now: int, given: float | None, is_trigger: bool, is_reset: bool) -> tuple[tuple, tuple | None]:
        """What is known of a device after a row, and the event that the row makes."""
        s = self.settings
        last_seq, accepted, blind, first_seq, warm_left, counted, triggered = known
        if is_trigger:
            return (last_seq, accepted, blind, first_seq, warm_left, counted, True), None
        seq, now = int(seq), int(now)
        if last_seq is not None and seq <= last_seq:
            if not is_reset:
                return known, (seq, now, None, "late", None, None) if s.report_late else None
            # The device counts anew: chunk numbers of the past mean nothing from here on.
            last_seq, blind, first_seq = None, None, None
        if last_seq is not None and seq > last_seq + 1 or is_reset:
            warm_left, counted, first_seq = s.warm_up, 0, None if warm_left else first_seq
        if warm_left > 0 and not (blind is not None and seq <= blind):
            return (seq, accepted, blind, first_seq, warm_left - 1, counted, triggered), None
        first_seq = seq if first_seq is None else first_seq
        if blind is not None and seq <= blind:
            return (seq, accepted, blind, first_seq, warm_left, counted, triggered), None
        source, score, event = None, None, None
        if triggered:
            triggered, source = False, "manual" if s.save else None
        elif s.scoring:
            counted += 1
            if counted % s.every == 0:
                score = float("-inf") if given is None or pd.isna(given) else float(given)
                hit = score >= s.threshold if s.inclusive else score > s.threshold
                if hit and (accepted is None or now - accepted >= s.cooldown_ms):
                    accepted, source = now, s.scorer
        if source:
            low, high = (max(first_seq, seq - s.pre_chunks + 1), seq + s.post_chunks) if s.save else (None, None)
            blind = high if s.save else blind
            event = seq, now, score, source, low, high
        return (seq, accepted, blind, first_seq, warm_left, counted, triggered), event

    def close(self) -> None:
        pass


def detector_input(chunks: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """Chunks and triggers of a device as one stream, with the columns the state machine reads.

    ``chunks`` needs ``device_id, seq, ts``; ``score`` and ``is_reset`` are optional.
    """
    have = chunks.columns
    empty = {"score": "double", "is_reset": "boolean"}
    optional = [
        F.col(n) if n in have else F.lit(False if n == "is_reset" else None).cast(t).alias(n) for n, t in empty.items()
    ]
    rows = chunks.select(
        "device_id", F.col("seq").cast("bigint").alias("seq"), F.unix_millis("ts").alias("ts_ms"),
        F.lit(False).alias("is_trigger"), *optional,
    )
    if triggers is None:
        return rows
    marks = triggers.select(
        "device_id", F.lit(-1).cast("bigint").alias("seq"), F.unix_millis("ts").alias("ts_ms"), F.lit(True).alias("is_trigger"),
        *[F.lit(False if n == "is_reset" else None).cast(t).alias(n) for n, t in empty.items()],
    )
    return rows.unionByName(marks)


def scored_stream(chunks: DataFrame, settings: DetectorSettings) -> DataFrame:
    """``device_id, seq, ts, is_reset, score``: chunks with the score of their analysis window.

    A ring of chunks in state makes the windows; comparing them is stateless, so a busy device's windows spread.
    """
    window = analysis_stream(chunks, settings.analysis_chunks, settings.ring_ttl_ms)
    score: Column = (rms_udf() if settings.scorer == "energy" else ncc_udf(settings.template))(F.coalesce("window", F.lit(b"")))
    return window.select("device_id", "seq", "ts", "is_reset", F.when(F.col("window").isNotNull(), score).alias("score"))


def detect_stream(chunks: DataFrame, settings: DetectorSettings, triggers: DataFrame | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """Detections and manual saves of every device, as a stream.

    Devices share state in ``buckets`` by a hash; a task holds the rows of a bucket in one micro-batch. More buckets suit
    more devices; a stream keeps its number for good.
    """
    rows = detector_input(chunks if settings.scorer == "given" else scored_stream(chunks, settings), triggers)
    key_type = rows.schema["device_id"].dataType
    bucket = F.when(F.col("device_id").isNotNull(), F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int"))
    return rows.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=ChunkDetector(settings, key_type), outputStructType=_events_type(key_type), outputMode="append",
        timeMode="None",
    )


class SessionPosition(StatefulProcessor):
    """Warm-up and throttle as a stream filter: passes every ``every``-th row after ``warm_up`` rows of a
    session; a reset row opens a new session."""

    def __init__(self, warm_up: int, every: int):
        self.warm_up, self.every = warm_up, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "session bigint, position bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts_ms", "row_id"])
        session, position = self.state.get() or (0, 0)
        resets = batch["is_reset"].to_numpy(dtype=bool)
        sessions = session + np.cumsum(resets)
        places = np.arange(1, len(batch) + 1)
        start = np.maximum.accumulate(np.where(resets, places, 0))
        positions = np.where(start > 0, places - start + 1, places + position)
        self.state.update((int(sessions[-1]), int(positions[-1])))
        passed = (positions > self.warm_up) & ((positions - self.warm_up) % self.every == 0)
        out = batch.loc[passed, ["row_id"]].copy()
        out.insert(0, "device_id", key[0])
        out["session"], out["position"] = sessions[passed], positions[passed]
        yield out

    def close(self) -> None:
        pass


def throttle_stream(rows: DataFrame, warm_up: int, every: int) -> DataFrame:
    """``device_id, row_id, ts_ms, is_reset`` in; passed rows with session and position out."""
    schema = T.StructType(
        [
            T.StructField("device_id", rows.schema["device_id"].dataType),
            T.StructField("row_id", T.LongType()),
            T.StructField("session", T.LongType()),
            T.StructField("position", T.LongType()),
        ]
    )
    return rows.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=SessionPosition(warm_up, every), outputStructType=schema, outputMode="append", timeMode="None"
    )
