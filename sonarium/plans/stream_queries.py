"""Driver queries that run the given tables through Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium import schemas
from sonarium.operators.features import encode_pcm16
from sonarium.operators.ordered import with_ordinal
from sonarium.plans import canonical as c
from sonarium.session import work_dir
from sonarium.sources.streams import match_trigger, run_to_table, stream_chunks, stream_files
from sonarium.streaming import detector, reorder, silence, windows

Spark = SparkSession


def stream_events(spark: Spark, d: str) -> DataFrame:
    """The events table as a stream; ``ts`` keeps its microseconds."""
    schema = c.table(spark, d, "events").schema
    return stream_files(spark, d, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _with_closing(spark: Spark, d: str, silence: str) -> tuple[DataFrame, Callable[[], None]]:
    """The event stream, and what closes it: a row ``silence`` after the newest event, read from a folder of its own.

    The row itself stays in a window that the watermark never passes.
    """
    events, folder = c.table(spark, d, "events"), work_dir(spark, "closing")
    events.limit(0).write.parquet(folder)

    def close() -> None:
        last = events.agg((F.max("ts") + F.expr(f"INTERVAL {silence}")).alias("ts"))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
        last.where("ts IS NOT NULL").select(F.col("ts").cast(events.schema["ts"].dataType).alias("ts"), *none).select(events.columns).write.mode("append").parquet(folder)

    end = stream_files(spark, folder, events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream_events(spark, d).unionByName(end), close


def _ms(name: str) -> list:
    return [F.unix_millis(name).alias(name)]


def stream_triggers(spark: Spark, d: str) -> DataFrame:
    rows = stream_events(spark, d).withColumn("payload", F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return run_to_table(rows.filter(match_trigger(F.col("payload"), "error")).select("event_id", "user_id"), "triggers")


def stream_cooldown(spark: Spark, d: str) -> DataFrame:
    """The detector without clips: threshold and anchored cooldown; equals its batch twin."""
    rows = stream_events(spark, d).select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), "ts", (F.col("value") / F.lit(c.SCORE_MAX)).alias("score")
    )
    settings = detector.DetectorSettings(scorer="given", threshold=0.2, cooldown_ms=240 * c.HOUR, save=False)
    found = detector.detect_stream(rows, settings)
    return run_to_table(found, "cooldown").select(
        F.col("seq").alias("event_id"), F.col("device_id").alias("user_id"), F.col("ts_ms").alias("start_ms")
    )


def stream_detect(spark: Spark, d: str) -> DataFrame:
    """The full state machine: manual triggers (errors) beside scores, clips and blind periods."""
    rows = stream_events(spark, d)
    chunks = rows.filter("event_type <> 'error'").select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), "ts", (F.col("value") / F.lit(c.SCORE_MAX)).alias("score")
    )
    triggers = rows.filter("event_type = 'error'").select(F.col("user_id").alias("device_id"), "ts")
    settings = detector.DetectorSettings(
        scorer="given", threshold=0.1, cooldown_ms=24 * c.HOUR, pre_chunks=200, post_chunks=400, save=True
    )
    return run_to_table(detector.detect_stream(chunks, settings, triggers), "detect")


def stream_throttle(spark: Spark, d: str) -> DataFrame:
    rows = stream_events(spark, d).select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("row_id"), F.unix_millis("ts").alias("ts_ms"),
        (F.col("event_type") == "error").alias("is_reset"),
    )
    return run_to_table(detector.throttle_stream(rows, 3, 2), "throttle").select(
        F.col("row_id").alias("event_id"), F.col("device_id").alias("user_id"), "session", "position"
    )


def stream_tumbling(spark: Spark, d: str) -> DataFrame:
    rows, close = _with_closing(spark, d, "2 DAYS")
    out = windows.event_windows(rows, ["event_type"], "6 hours", delay="1 hour")
    return run_to_table(out, "tumbling", close=close).select("event_type", *_ms("window_start"), *_ms("window_end"), "n")


def stream_sliding(spark: Spark, d: str) -> DataFrame:
    rows, close = _with_closing(spark, d, "3 DAYS")
    out = windows.event_windows(rows, ["event_type"], "24 hours", "6 hours", delay="1 hour")
    return run_to_table(out, "sliding", close=close).select("event_type", *_ms("window_start"), *_ms("window_end"), "n")


def stream_sessions(spark: Spark, d: str) -> DataFrame:
    rows, close = _with_closing(spark, d, "2 DAYS")
    out = windows.session_windows(rows, ["user_id"], "12 hours", delay="1 hour")
    return run_to_table(out, "sessions", close=close).select("user_id", *_ms("session_start"), *_ms("session_end"), "n")


def stream_dedup(spark: Spark, d: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    rows = stream_events(spark, d).select("event_id", "user_id", "ts")
    twice = rows.unionByName(rows)
    return run_to_table(windows.drop_repeats(twice, ["user_id", "event_id"], "2 days"), "dedup").select("event_id", "user_id")


def stream_rechunk(spark: Spark, d: str) -> DataFrame:
    rows, close = _with_closing(spark, d, "3 DAYS")
    out = windows.rechunk(rows.select("user_id", "ts", "value"), "user_id", "1 day", "1 hour")
    return run_to_table(out, "rechunk", close=close).select(
        "user_id", *_ms("ts"), F.size("values").alias("n"), F.round(c.checksum("values"), 4).alias("checksum")
    )


def stream_clip_join(spark: Spark, d: str) -> DataFrame:
    """Strong purchases joined to the user's events from 12 hours before to 24 hours after."""
    rows = stream_events(spark, d)
    found = rows.filter("event_type = 'purchase' AND value >= 100").select(
        "user_id", F.col("ts").alias("trigger_ts"), F.col("event_id").alias("trigger_id")
    )
    chunks = stream_events(spark, d).select("user_id", "ts", "event_id")
    out = windows.clip_join(found, chunks, "user_id", 12 * 3600, 24 * 3600, "1 hour")
    return run_to_table(out, "clip_join").select("user_id", "trigger_id", "event_id")


def stream_last_seen(spark: Spark, d: str) -> DataFrame:
    out = windows.last_seen(stream_events(spark, d), "user_id")
    return run_to_table(out, "last_seen", mode="complete").select("user_id", *_ms("last_seen"))


#: A user without events for longer than this is silent.
SILENCE_MS = 60 * c.HOUR


def stream_silent(spark: Spark, d: str) -> DataFrame:
    """Every silence of a user, and those that last at the end."""
    rows, close = _with_closing(spark, d, "9 DAYS")
    beats = rows.select(F.coalesce("user_id", F.lit(-1)).cast("bigint").alias("user_id"), "ts")  # -1 closes the stream
    out = silence.silent_stream(beats, SILENCE_MS, "user_id")
    return run_to_table(out, "silent", close=close).where("user_id <> -1")


#: How late events may come, and into how many arrivals they are cut.
DELAY_MS = 6 * c.HOUR
ARRIVALS = 4


def _arrivals(spark: Spark, events: DataFrame) -> str:
    """A folder of events in shuffled order, file after file, none more than the delay late; a far later row closes it."""
    folder = work_dir(spark, "arrivals")
    shift = F.pmod(F.xxhash64("event_id"), F.lit(DELAY_MS))
    rows = events.withColumn("_arrival", F.unix_millis(F.col("ts").cast("timestamp")) + shift)
    low, high = rows.agg(F.min("_arrival"), F.max("_arrival")).first()
    step = ((high or 0) - (low or 0)) // ARRIVALS + 1
    for i in range(ARRIVALS):
        part = rows.where(F.floor((F.col("_arrival") - F.lit(low)) / F.lit(step)) == i)
        part.drop("_arrival").repartition(1).write.mode("append").parquet(folder)
    _tick(events, "2 DAYS").write.mode("append").parquet(folder)
    return folder


def _tick(events: DataFrame, later: str) -> DataFrame:
    """A row of user -1, some time after the newest event."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {later}")).alias("ts")).where("ts IS NOT NULL")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in ("ts", "event_id", "user_id")]
    known = [F.lit(v).cast(events.schema[n].dataType).alias(n) for n, v in (("event_id", 0), ("user_id", -1))]
    return last.select(F.col("ts").cast(events.schema["ts"].dataType).alias("ts"), *known, *none).select(events.columns)


def _reordered(spark: Spark, folder: str, schema) -> DataFrame:
    rows = stream_files(spark, folder, schema, files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
    return reorder.reorder_stream(rows.select("user_id", "event_id", "ts", "value"), DELAY_MS, "user_id", "event_id")


def stream_reorder(spark: Spark, d: str) -> DataFrame:
    """Shuffled arrivals in order; errors come after all others, most of them too late."""
    events = c.table(spark, d, "events")
    folder = _arrivals(spark, events.where("event_type <> 'error'"))

    def close() -> None:
        events.where("event_type = 'error'").unionByName(_tick(events, "9 DAYS")).repartition(1).write.mode("append").parquet(folder)

    found = run_to_table(_reordered(spark, folder, events.schema), "reorder", close=close).where("user_id <> -1")
    return found.select(F.col("seq").alias("event_id"), "user_id", "position", "late")


def stream_late(spark: Spark, d: str) -> DataFrame:
    """What the re-order buffer released, and what came too late, by user."""
    return stream_reorder(spark, d).groupBy("user_id").agg(F.count("position").alias("n_released"), F.count_if("late").alias("n_late"))


def stream_reorder_cooldown(spark: Spark, d: str) -> DataFrame:
    """Detection behind the re-order buffer, two states in one stream: as if all had come in order."""
    events = c.table(spark, d, "events")
    rows = _reordered(spark, _arrivals(spark, events), events.schema).where("NOT late AND user_id <> -1").select(
        F.col("user_id").alias("device_id"), "seq", F.timestamp_millis("ts_ms").alias("ts"), (F.col("value") / F.lit(c.SCORE_MAX)).alias("score")
    )
    settings = detector.DetectorSettings(scorer="given", threshold=0.2, cooldown_ms=240 * c.HOUR, save=False)
    return run_to_table(detector.detect_stream(rows, settings), "reorder_cooldown").select(
        F.col("seq").alias("event_id"), F.col("device_id").alias("user_id"), F.col("ts_ms").alias("start_ms")
    )


def _level() -> Column:
    return F.lit(0.4) + F.pmod("seq", F.lit(5)).cast("double") * F.lit(0.12)


def _sound(spark: Spark, d: str) -> DataFrame:
    """Embeddings as a stream of PCM chunks of five levels: a device for each label, half a second for each vector."""
    rows = with_ordinal(c.signals(spark, d).where("size(samples) > 0"), ["label"], ["vec_id"], 65536, "seq")
    chunks = rows.select(
        F.concat(F.lit("dev_"), F.col("label").cast("string")).alias("device_id"), "seq",
        F.timestamp_millis(F.col("seq") * 500).alias("ts"), encode_pcm16(F.transform("samples", lambda x: x * _level())).alias("pcm"),
    )
    folder = work_dir(spark, "sound")
    chunks.select(*schemas.CHUNK_STREAM.names).write.parquet(folder)
    return stream_chunks(spark, folder)


def _first_vector(spark: Spark, d: str) -> list[float]:
    """The samples of the first vector, as a chunk holds them."""
    row = c.signals(spark, d).orderBy("vec_id").select("samples").first()
    return [float(int(x)) / 32768.0 for x in row.samples]


def stream_template(spark: Spark, d: str) -> DataFrame:
    """Windows of two chunks that resemble the first vector."""
    settings = detector.DetectorSettings(
        template=_first_vector(spark, d), threshold=0.36, cooldown_ms=2_000, analysis_chunks=2, save=False, report_late=True
    )
    found = run_to_table(detector.detect_stream(_sound(spark, d), settings), "template", idle=False)
    return found.select("device_id", "seq", "ts_ms", "source")


def stream_energy(spark: Spark, d: str) -> DataFrame:
    """Windows of two chunks that are loud, with the clips around them."""
    settings = detector.DetectorSettings(scorer="energy", threshold=0.052, cooldown_ms=1_500, analysis_chunks=2, pre_chunks=3, post_chunks=4)
    found = run_to_table(detector.detect_stream(_sound(spark, d), settings), "energy", idle=False)
    return found.select("device_id", "seq", "ts_ms", F.round("score", 9).alias("score"), "source", "clip_from", "clip_to")


STREAMS = {
    f.__name__: f
    for f in (
        stream_triggers, stream_cooldown, stream_detect, stream_throttle, stream_tumbling, stream_sliding,
        stream_sessions, stream_dedup, stream_rechunk, stream_clip_join, stream_last_seen, stream_reorder, stream_late,
        stream_reorder_cooldown, stream_template, stream_energy, stream_silent,
    )
}
