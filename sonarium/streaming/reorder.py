"""Chunks that arrive out of order: held back for a stated delay, then released in order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Waiting chunks lie in so many parts of a delay, so that a release touches few of them.
PARTS = 8
#: Devices share state in so many buckets: a call to the state costs far more than a chunk.
BUCKETS = 128


def _plain(value):
    """What state can store: no NumPy scalars, no NaN for a missing value."""
    if value is None or isinstance(value, float) and np.isnan(value) or value is pd.NaT or value is pd.NA:
        return None
    return value.item() if isinstance(value, np.generic) else value


class ReorderBuffer(StatefulProcessor):
    """Per bucket of devices: waiting chunks by time, and of every device the place of the last released one and how many
    there were.

    A chunk is released once the watermark has passed its time, so all that came within the delay stand in order. One
    that belongs before a released chunk of its device goes out at once, marked late and without a position. A timer
    stands at the earliest waiting chunk of the bucket only.
    """

    def __init__(self, fields: Sequence[T.StructField], key: T.StructField, part_ms: int):
        self.fields, self.key, self.part_ms = list(fields), key, part_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        place = [self.key, T.StructField("ts_ms", T.LongType()), T.StructField("seq", T.LongType())]
        devices = T.ArrayType(T.StructType([*place, T.StructField("released", T.LongType())]))
        # Pickled lists of plain rows: taking them apart field by field costs more than all else here.
        self.waiting = handle.getMapState("waiting", "part bigint", "rows binary")
        self.last = handle.getValueState("last", T.StructType([T.StructField("devices", devices)]))
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at: int | None) -> None:
        """Let the timer stand at ``at``."""
        known = self.timer.get()
        if known and known[0] == at:
            return
        if known:
            self.handle.deleteTimer(known[0])
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _released(self) -> dict:
        """Of every device the time and number of the last released chunk, and how many there were."""
        stored = self.last.get()
        return {device: (at, seq, n) for device, at, seq, n in stored[0]} if stored else {}

    def _parts(self) -> list[int]:
        return [part for (part,) in self.waiting.keys()]

    def _held(self, part: int) -> list[tuple]:
        return pickle.loads(self.waiting.getValue((part,))[0])

    def _keep(self, part: int, rows: list[tuple]) -> None:
        self.waiting.updateValue((part,), (pickle.dumps(rows),))

    def _frame(self, rows: list[tuple], positions: list[int | None]) -> pd.DataFrame:
        columns = [self.key.name, "ts_ms", "seq", *[f.name for f in self.fields]]
        out = pd.DataFrame(rows, columns=columns, dtype=object)
        return out.assign(position=pd.Series(positions, dtype="Int64"), late=[p is None for p in positions])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, watermark = self._released(), timerValues.getCurrentWatermarkInMs()
        late, soonest, parts = [], None, {}
        names = [self.key.name, "ts_ms", "seq", *[f.name for f in self.fields]]
        for frame in rows:
            for row in zip(*[frame[n] for n in names]):
                row = tuple(map(_plain, row))
                if row[0] in last and row[1:3] <= last[row[0]][:2]:
                    late.append(row)
                else:
                    parts.setdefault(row[1] // self.part_ms, []).append(row)
                    soonest = row[1] if soonest is None else min(soonest, row[1])
        stored = set(self._parts()) if parts else set()
        for part, new in parts.items():
            self._keep(part, self._held(part) + new if part in stored else new)
        if late:
            yield self._frame(late, [None] * len(late))
        known = self.timer.get()
        if soonest is not None and soonest < watermark:
            # The watermark has passed it already: nothing is left to wait for.
            yield from self._release(watermark)
        elif soonest is not None and (not known or soonest + 1 < known[0]):
            self._wake(soonest + 1)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # the timer that fired is gone
        yield from self._release(timerValues.getCurrentWatermarkInMs())

    def _release(self, watermark: int) -> Iterator[pd.DataFrame]:
        ready, soonest, parts = [], None, sorted(self._parts())
        passed = [part for part in parts if part * self.part_ms < watermark]
        whole = {}
        if 2 * len(passed) > len(parts):
            # Most of it goes: one pass over the state is far cheaper than calls for every part.
            whole = {part: pickle.loads(rows) for (part,), (rows,) in self.waiting.iterator()}
            self.waiting.clear()
        for part in parts:
            if part not in whole and part not in passed:
                soonest = min(r[1] for r in self._held(part))
                break
            held = whole[part] if whole else self._held(part)
            rest = [r for r in held if r[1] >= watermark]
            ready += [r for r in held if r[1] < watermark]
            if rest:
                soonest = min([r[1] for r in rest] + ([] if soonest is None else [soonest]))
                if whole or len(rest) < len(held):
                    self._keep(part, rest)
                if not whole:
                    break
            elif not whole:
                self.waiting.removeKey((part,))
        self._wake(None if soonest is None else soonest + 1)
        # A chunk that came twice goes out once.
        ready = sorted({r[:3]: r for r in ready}.values(), key=lambda r: r[1:3])
        if ready:
            last, positions = self._released(), []
            for device, at, seq, *_ in ready:
                positions.append((last[device][2] if device in last else 0) + 1)
                last[device] = at, seq, positions[-1]
            self.last.update(([(device, *place) for device, place in last.items()],))
            yield self._frame(ready, positions)

    def close(self) -> None:
        pass


def reorder_stream(chunks: DataFrame, delay_ms: int, key: str = "device_id", seq: str = "seq", time: str = "ts",
                   buckets: int = BUCKETS) -> DataFrame:
    """Every chunk once, in order of time and number per device, if it comes at most ``delay_ms`` late.

    Adds ``ts_ms``, ``position`` (from 1 per device, in the order of release) and ``late``. A chunk that comes after one
    that follows it was released has no position and ``late`` set: nothing vanishes, and late chunks can be counted. The
    watermark is that of all devices; rows wait until it has passed them, so the stream's last rows need a later one
    behind them. Chunks with equal time and number count as one. A chunk without device, time or number fails.

    Devices share state in ``buckets`` by a hash; a task holds the waiting chunks of a bucket in one part of the delay
    and a few numbers for each of its devices. More buckets suit more devices; a stream keeps its number for good.
    """
    others = [f for f in chunks.schema if f.name not in (key, seq, time)]
    if clash := {f.name for f in others} & {"ts_ms", "seq", "position", "late", "_bucket"}:
        raise ValueError(f"columns named {sorted(clash)} stand in the way")
    missing = F.raise_error(F.lit("a chunk needs a device, a time and a number"))
    rows = chunks.withWatermark(time, f"{delay_ms} milliseconds").select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket"),
        # Beside a null key, pandas would turn whole numbers into floats and miss their state.
        F.coalesce(key, missing.cast(chunks.schema[key].dataType)).alias(key),
        # Without the watermark's mark on the column, late rows reach the state and can be counted.
        F.coalesce(F.unix_millis(time), missing.cast("bigint")).alias("ts_ms"),
        F.coalesce(F.col(seq).cast("bigint"), missing.cast("bigint")).alias("seq"), *[f.name for f in others],
    )
    schema = T.StructType([chunks.schema[key], T.StructField("ts_ms", T.LongType()), T.StructField("seq", T.LongType()), *others,
                           T.StructField("position", T.LongType()), T.StructField("late", T.BooleanType())])
    buffer = ReorderBuffer(others, chunks.schema[key], max(1, delay_ms // PARTS))
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=buffer, outputStructType=schema, outputMode="append", timeMode="EventTime")
