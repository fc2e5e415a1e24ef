"""The last few chunks of every device as one analysis window, from state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: A device silent for so long starts with an empty ring.
RING_TTL_MS = 10 * 60_000


class AnalysisRing(StatefulProcessor):
    """Keeps the ``n - 1`` newest chunks of a device and sends every chunk on with those before it.

    The ring starts anew at a gap in the chunk numbers and at a reset. A chunk that is not newer than the ring's last goes
    on without a window. State that nobody has touched for ``ttl_ms`` is dropped by the store.
    """

    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "seq bigint, pcm binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # The rows of one device in one micro-batch: bounded by the source's rate limit.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], ignore_index=True)
        ring = [(int(seq), pcm) for seq, pcm in self.ring.get()]
        windows = []
        for seq, pcm, reset in zip(batch["seq"], batch["pcm"], batch["is_reset"]):
            if ring and not reset and seq <= ring[-1][0]:
                windows.append(None)
                continue
            if reset or ring and seq > ring[-1][0] + 1:
                ring = []
            ring = [*ring, (int(seq), pcm or b"")][-max(self.n, 1) :]
            windows.append(b"".join(c for _, c in ring))
        # One chunk at least stays, so that its number is known.
        self.ring.put(ring[-max(self.n - 1, 1) :])
        out = batch[["seq", "ts", "is_reset"]].assign(window=pd.Series(windows, dtype=object))
        out.insert(0, "device_id", key[0])
        yield out

    def close(self) -> None:
        pass


def analysis_stream(chunks: DataFrame, n: int, ttl_ms: int = RING_TTL_MS) -> DataFrame:
    """``device_id, seq, ts, is_reset, window``: the bytes of every chunk's last ``n`` chunks, itself included.

    ``chunks`` needs ``device_id, seq, ts, pcm``; ``is_reset`` is optional. Scores of the windows are stateless
    expressions, so they run in parallel whatever device the windows come from.
    """
    reset = F.coalesce("is_reset", F.lit(False)) if "is_reset" in chunks.columns else F.lit(False)
    rows = chunks.select("device_id", F.col("seq").cast("bigint").alias("seq"), "ts", "pcm", reset.alias("is_reset"))
    schema = T.StructType([rows.schema["device_id"], rows.schema["seq"], rows.schema["ts"], T.StructField("is_reset", T.BooleanType()),
                           T.StructField("window", T.BinaryType())])
    return rows.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=AnalysisRing(n, ttl_ms), outputStructType=schema, outputMode="append", timeMode="ProcessingTime"
    )
