"""Devices that fall silent: one timer per device, one row per silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


class SilenceWatch(StatefulProcessor):
    """Per device: its newest heartbeat, and a timer where it will have been silent for too long.

    A heartbeat moves the timer. A timer that fires gives one row and is not set again before the next heartbeat. On the
    event clock a gap between two heartbeats of one batch is a silence as well, so that batches do not matter.
    """

    def __init__(self, key: T.StructField, max_age_ms: int, by_event: bool):
        self.key, self.max_age_ms, self.by_event = key, max_age_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_seen bigint, timer bigint")

    def _frame(self, key, last_seen: list[int]) -> pd.DataFrame:
        times = np.array(last_seen, np.int64)
        return pd.DataFrame({self.key.name: pd.Series([key[0]] * len(times), dtype=object), "last_seen": times, "silent_at": times + self.max_age_ms})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([frame["ts_ms"].to_numpy(np.int64) for frame in rows]))
        last, timer = self.seen.get() or (None, None)
        times = times if last is None else times[times > last]
        if not len(times):
            return  # nothing newer than what is known
        if self.by_event:
            # The silence after the last known heartbeat is told already if its timer is gone.
            known = times if timer is None else np.concatenate([[last], times])
            ended = known[:-1][np.diff(known) > self.max_age_ms]
            if len(ended):
                yield self._frame(key, ended.tolist())
        if timer is not None:
            self.handle.deleteTimer(timer)
        begin = int(times[-1]) if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(begin + self.max_age_ms + 1)
        self.seen.update((int(times[-1]), begin + self.max_age_ms + 1))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        self.seen.update((last, None))  # the timer that fired is gone
        yield self._frame(key, [last])

    def close(self) -> None:
        pass


def silent_stream(rows: DataFrame, max_age_ms: int, key: str = "device_id", time: str = "ts", clock: str = "event",
                  delay: str = "0 seconds") -> DataFrame:
    """``key, last_seen, silent_at`` (ms), once for each silence of a device longer than ``max_age_ms``.

    ``clock='event'`` measures between the times of heartbeats and tells a silence that still lasts when the watermark,
    ``delay`` behind the newest row of all devices, has passed its limit. ``clock='processing'`` measures from the arrival of the
    newest heartbeat by the clock of the cluster, and asks for batches as long as the stream runs. Rows of a device should
    come in order (else put :func:`reorder_stream` before); one older than its newest is ignored. State holds two
    numbers per device. A row without device or time fails.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock is 'event' or 'processing'")
    by_event = clock == "event"
    missing = F.raise_error(F.lit("a heartbeat needs a device and a time"))
    marked = rows.withWatermark(time, delay) if by_event else rows
    # Without the watermark's mark on the column, rows of a device behind the others still reach its state.
    beats = marked.select(
        F.coalesce(key, missing.cast(rows.schema[key].dataType)).alias(key),
        F.coalesce(F.unix_millis(time), missing.cast("bigint")).alias("ts_ms"),
    )
    schema = T.StructType([rows.schema[key], T.StructField("last_seen", T.LongType()), T.StructField("silent_at", T.LongType())])
    return beats.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SilenceWatch(rows.schema[key], max_age_ms, by_event), outputStructType=schema, outputMode="append",
        timeMode="EventTime" if by_event else "ProcessingTime",
    )
