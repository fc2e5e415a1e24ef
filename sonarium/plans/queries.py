"""Driver queries: every operator over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions import scalars, signal, uri
from sonarium.functions.keys import pick, uniform
from sonarium.operators import detect, features, intervals, lookups, metrics, noise, ordered, sampling, splitting, tiles
from sonarium.plans import canonical as c
from sonarium.session import materialize, work_dir
from sonarium.sources import folders, sinks, tables
from sonarium.sources.audio import audio_info, decode_wavs, scan_audio, wav_info

Spark = SparkSession


def _round(column: Column | str, digits: int, name: str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits).alias(name)


# ------------------------------------------------------------------ references and annotations


def uri_shapes(spark: Spark, d: str) -> DataFrame:
    """Every page address in the shapes a label export may hold."""
    url = F.col("url")
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    s3 = F.concat(F.lit("s3://media"), path)
    shapes = {
        "plain": url,
        "presigned": F.concat(F.lit("https://store.example.com/media"), path, F.lit("?X-Amz-Expires=3600&X-Amz-Signature=abc")),
        "virtual": F.concat(F.lit("https://media.s3.eu-central-1.example.com"), path),
        "s3": F.concat(s3, F.lit("?versionId=1")),
        "resolver": F.concat(F.lit("/data/s3/?fileuri="), s3),
        "encoded": F.concat(F.lit("/data/s3/?fileuri="), F.base64(s3.cast("binary"))),
        "foreign": F.concat(F.lit("/data/local-files/?d="), path),
    }
    return (
        c.table(spark, d, "pages")
        .select("page_id", F.explode(F.create_map(*[x for k, v in shapes.items() for x in (F.lit(k), v)])).alias("shape", "audio"))
    )


def normalize_uri(spark: Spark, d: str) -> DataFrame:
    rows = uri_shapes(spark, d).withColumn("uri", uri.normalize_uri("audio", mode="null"))
    parts = uri.split_uri("uri", mode="null")
    return rows.select(
        "page_id", "shape", "uri", uri.file_name("uri").alias("file_name"),
        parts["bucket"].alias("bucket"), parts["key"].alias("key"),
    )


def label_export(spark: Spark, d: str) -> DataFrame:
    """A label export derived from events: blank, empty and multi-interval cells."""
    items = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 3),
        lambda i: F.struct(
            (i * 2 + F.lit(0.25)).alias("start"),
            (i * 2 + F.lit(0.25) + F.col("value")).alias("end"),
            F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("extra"))).otherwise(F.array("event_type")).alias("labels"),
            F.lit(0).alias("channel"),
        ),
    )
    label = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "signup", "[]").otherwise(F.to_json(items))
    return c.events(spark, d).select(
        F.col("event_id").alias("annotation_id"),
        F.col("user_id").alias("id"),
        F.concat(F.lit("https://store.example.com/rec/user_"), "user_id", F.lit("/ev_"), "event_id", F.lit(".wav?sig=1")).alias("audio"),
        label.alias("label"),
    )


def explode_annotations(spark: Spark, d: str) -> DataFrame:
    return intervals.explode_annotations(label_export(spark, d), keep_order=True)


def default_annotation(spark: Spark, d: str) -> DataFrame:
    tasks = c.table(spark, d, "documents").select("doc_id", "source")
    bare = intervals.unannotated(tasks, c.table(spark, d, "labels"), "doc_id", "doc_id")
    return intervals.default_annotation(bare).select(
        "doc_id", "source", "start", "end", "channel", F.element_at("labels", 1).alias("label")
    )


def fill_and_group(spark: Spark, d: str) -> DataFrame:
    rows = c.events(spark, d).select(
        F.col("event_id").cast("string").alias("annotation_id"),
        (F.col("start_ms") / 1000.0).alias("start"),
        F.when(F.col("event_id") % 2 == 0, F.col("start_ms") / 1000.0 + F.col("value")).alias("end"),
        F.concat(F.lit("rec_"), F.col("user_id").cast("string")).alias("audio_file_name"),
        "event_type",
    )
    real = rows.filter(F.col("event_type").isin("click", "view", "purchase"))
    made = rows.filter("event_type = 'signup'").withColumn("split_group", F.concat(F.lit("src_"), "annotation_id"))
    pool = rows.filter("event_type = 'error'").withColumn("noise_pool", F.lit("ext"))
    together = intervals.union_sources(real, made, pool)
    info = c.events(spark, d).groupBy(F.concat(F.lit("rec_"), F.col("user_id").cast("string")).alias("audio_file_name")).agg(
        (F.max("start_ms") / 1000.0).alias("duration_s")
    )
    filled = scalars.fill_missing(lookups.attach_duration(together, info), "split_group", "audio_file_name")
    bounds = intervals.with_bounds(filled)
    return bounds.select("annotation_id", "event_type", "noise_pool", "split_group", "audio_file_duration", "start_ms", "end_ms")


# --------------------------------------------------------------------------- windows and counts


def slide_windows(spark: Spark, d: str) -> DataFrame:
    return c.windows(spark, d).select("event_id", "label", "noise_pool", "chunk_start", "chunk_end")


def count_per_label(spark: Spark, d: str) -> DataFrame:
    return metrics.count_per_label(c.windows(spark, d))


def label_distribution(spark: Spark, d: str) -> DataFrame:
    return metrics.label_distribution(c.events(spark, d), "event_type")


def positive_total(spark: Spark, d: str) -> DataFrame:
    return metrics.positive_total(c.windows(spark, d))


def quality_metrics(spark: Spark, d: str) -> DataFrame:
    rows = c.windows(spark, d).select(
        F.when(F.col("noise_pool") == "signup", None).otherwise(F.col("user_id")).alias("file_id"),
        F.when(F.col("noise_pool") == "error", None).otherwise(F.col("label")).alias("label"),
    )
    row = metrics.quality_metrics(rows)
    return row.withColumn("imbalance_ratio", F.round("imbalance_ratio", 9))


# ------------------------------------------------------------------------ joins and set operations


def sync_plan(spark: Spark, d: str) -> DataFrame:
    """Orders of the line items are wanted; the doubled order numbers stand for the files at hand."""
    expected = c.table(spark, d, "lineitem").select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("audio_file_name"),
        F.concat(F.lit("s3://raw/"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string")).alias("remote_audio_path"),
    )
    existing = c.table(spark, d, "orders").select(
        F.concat(F.lit("order_"), (F.col("o_orderkey") * 2).cast("string")).alias("audio_file_name")
    )
    return lookups.sync_plan(expected, existing)


def name_difference(spark: Spark, d: str) -> DataFrame:
    return lookups.difference(c.table(spark, d, "documents"), c.table(spark, d, "labels"), "doc_id")


def distinct_first(spark: Spark, d: str) -> DataFrame:
    rows = c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lookups.distinct_first(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


def exclude_values(spark: Spark, d: str) -> DataFrame:
    return lookups.exclude_values(c.events(spark, d), "event_type", ["error", "signup"]).select("event_id", "event_type")


def resolve_first(spark: Spark, d: str) -> DataFrame:
    def source(name: str, key: str, folder: str) -> tuple[DataFrame, str]:
        names = c.table(spark, d, name).select(F.concat(F.lit("f"), F.col(key).cast("string"), F.lit(".wav")).alias("name"))
        return names.withColumn("path", F.concat(F.lit(f"{folder}/"), "name")), folder

    names = c.table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".wav")).alias("name")
    ).distinct()
    found = lookups.resolve_first(
        names, "name",
        [source("supplier", "s_suppkey", "recordings"), source("customer", "c_custkey", "augmented"), source("part", "p_partkey", "pools")],
    )
    return found.select("name", "path", "source")


# ------------------------------------------------------------------- sampling, balance, splitting


def sample_n(spark: Spark, d: str) -> DataFrame:
    return sampling.sample_n(c.events(spark, d), 500, 42, ["event_id"]).select("event_id", "user_id", "value")


def split_draw(spark: Spark, d: str) -> DataFrame:
    counts = c.events(spark, d).groupBy("user_id").agg(
        (F.count(F.when(F.col("event_type") == "purchase", 1)) * 3).alias("n_target"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("have_real"),
        F.count(F.when(F.col("event_type").isin("error", "signup"), 1)).alias("have_external"),
    )
    ratio = (F.col("user_id") % 5) / F.lit(4.0)
    return counts.withColumn("drawn", sampling.split_draw(F.col("n_target"), ratio, F.col("have_real"), F.col("have_external"))).select(
        "user_id", "n_target", "have_real", "have_external", "drawn.n_real", "drawn.n_external"
    )


def balance(spark: Spark, d: str) -> DataFrame:
    return sampling.balance(c.stored_windows(spark, d), ["event_id", "chunk_start"]).select(
        "event_id", "label", "noise_pool", "chunk_start"
    )


def balanced_windows(spark: Spark, d: str) -> DataFrame:
    """Flagship: balance the windows, then count them per label and pool."""
    return window_totals(balance(spark, d))


def window_totals(windows: DataFrame) -> DataFrame:
    """``label, noise_pool, n_windows, sum_start``. The sum is a bigint, or, where one of them does not fit that, a decimal."""
    total = F.sum(F.col("chunk_start").cast("decimal(19,0)")).cast("decimal(38,0)")
    counts = materialize(windows.groupBy("label", "noise_pool").agg(F.count(F.lit(1)).alias("n_windows"), total.alias("sum_start")), "totals")
    wide = counts.where(~F.col("sum_start").between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")))
    return counts if not wide.isEmpty() else counts.withColumn("sum_start", F.col("sum_start").cast("bigint"))


def background_shortfall(spark: Spark, d: str) -> DataFrame:
    return sampling.background_shortfall(c.windows(spark, d), ratio=5.0)


def shuffle_rank(spark: Spark, d: str) -> DataFrame:
    return sampling.shuffle_rank(c.table(spark, d, "orders").select("o_orderkey"), 42, ["o_orderkey"])


def _split(spark: Spark, d: str) -> DataFrame:
    rows = c.events(spark, d).select("event_id", "user_id", c.event_label().alias("label"))
    return splitting.group_split(rows, "user_id", "label")


def group_split(spark: Spark, d: str) -> DataFrame:
    return _split(spark, d).select("event_id", "user_id", "fold", "is_test")


def leakage_check(spark: Spark, d: str) -> DataFrame:
    return splitting.leakage(_split(spark, d), "user_id")


def split_shape(spark: Spark, d: str) -> DataFrame:
    rows = _split(spark, d).withColumn("features", F.array("event_id", "user_id"))
    return metrics.dataset_shape(rows, "features")


# ------------------------------------------------------------------------------- sample arithmetic


def sample_power(spark: Spark, d: str) -> DataFrame:
    return c.signals(spark, d, gain=1.0).select(
        "vec_id", _round(signal.sample_power("samples"), 6, "power"), _round(signal.rms("samples"), 6, "rms"),
        _round(signal.peak("samples"), 6, "peak"), _round(signal.zero_crossings("samples"), 6, "zcr"),
    )


def circular_shift(spark: Spark, d: str) -> DataFrame:
    rows = c.signals(spark, d, gain=1.0).withColumn("shift", pick(F.size("samples"), 42, F.lit("shift"), F.col("vec_id")))
    return rows.select("vec_id", "shift", _round(c.checksum(signal.circular_shift("samples", F.col("shift"))), 6, "checksum"))


def mix_at_snr(spark: Spark, d: str) -> DataFrame:
    """Every recording mixed with its successor, the last with the first, at five SNRs and two shifts."""
    rows = c.signals(spark, d)
    ends = rows.agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    before = F.when(F.col("vec_id") == F.col("low"), F.col("high")).otherwise(F.col("vec_id") - 1)
    # the ends are one row
    follower = rows.crossJoin(F.broadcast(ends)).select(before.alias("vec_id"), F.col("samples").alias("noise"))
    pairs = noise.cross_variants(rows.select("vec_id", "samples").join(follower, "vec_id"))
    shifted = pairs.withColumn("shift", pick(64, 42, F.col("vec_id"), F.col("snr_db"), F.col("pair_no"))).withColumn(
        "noise", signal.circular_shift("noise", F.col("shift"))
    )
    mixed = shifted.withColumn("mixed", signal.mix_at_snr("samples", "noise", F.col("snr_db")))
    return mixed.select(
        "vec_id", "snr_db", "pair_no", _round(signal.peak("mixed"), 3, "peak"),
        _round(c.checksum("mixed"), 2, "checksum"),
    )


def gain_jitter(spark: Spark, d: str) -> DataFrame:
    rows = c.signals(spark, d).withColumn("gain_db", uniform(-6.0, 6.0, 42, F.lit("gain"), F.col("vec_id")))
    loud = rows.withColumn("loud", signal.apply_gain("samples", F.col("gain_db")))
    return loud.select("vec_id", _round("gain_db", 6, "gain_db"), _round(signal.peak("loud"), 3, "peak"), _round(c.checksum("loud"), 2, "checksum"))


def _embedding_spans(spark: Spark, d: str) -> DataFrame:
    """Labelled spans inside the recordings; one in four runs past the end of its file."""
    start = F.col("vec_id") % 5
    end = F.when(F.col("vec_id") % 4 == 0, F.lit(90)).otherwise(F.lit(64) - F.col("vec_id") % 3)
    return c.signals(spark, d).withColumn("start_ms", start.cast("bigint")).withColumn("end_ms", end.cast("bigint"))


def index_windows(spark: Spark, d: str) -> DataFrame:
    return intervals.index_windows(_embedding_spans(spark, d).drop("samples"), 32, 4).select("vec_id", "chunk_start", "start_sample", "length")


def index_pool(spark: Spark, d: str) -> DataFrame:
    return intervals.index_pool(c.signals(spark, d).drop("samples"), 32, 8).select("vec_id", "noise_pool", "start_sample", "length")


def extract_windows(spark: Spark, d: str) -> DataFrame:
    index = intervals.index_windows(_embedding_spans(spark, d).drop("samples"), 32, 4).select("path", "vec_id", "start_sample")
    audio = c.signals(spark, d, gain=1.0).select("path", "frames", "samples")
    cut = lookups.attach_samples(index, audio, 32)
    return cut.select("vec_id", "start_sample", F.size("window").alias("n"), _round(c.checksum("window"), 6, "checksum"))


def pool_rows(spark: Spark, d: str) -> DataFrame:
    return intervals.pool_rows(c.signals(spark, d), F.col("noise_pool"))


def _draw_inputs(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    rows = c.signals(spark, d)
    spans = rows.filter("label > 0").select(
        "noise_pool", "path", F.lit(0).cast("bigint").alias("start_ms"), F.col("frames").alias("end_ms"), "rate", "frames"
    )
    return rows, spans


def draw_noise(spark: Spark, d: str) -> DataFrame:
    rows, spans = _draw_inputs(spark, d)
    return noise.draw_noise(rows.select("vec_id"), "vec_id", spans, c.POOLS, 32, 8).select(
        "vec_id", "noise_pool", "path", "start_sample"
    )


def augment(spark: Spark, d: str) -> DataFrame:
    """Every window of every signal recording, mixed with drawn noise."""
    rows, spans = _draw_inputs(spark, d)
    starts = F.sequence(F.lit(0), F.lit(64 - 32 - 1), F.lit(8))
    found = rows.filter("label = 0").select("vec_id", "samples", "path", F.explode(starts).alias("at")).select(
        F.concat_ws("_", "vec_id", "at").alias("signal_id"), F.slice("samples", F.col("at") + 1, 32).alias("window"),
        F.col("path").alias("split_group"),
    )
    audio = rows.filter("label > 0").select("path", "frames", "samples")
    made = noise.augment(found, spans, audio, c.POOLS, "bell", 32, 8, rate=1000)
    return made.select(
        "annotation_id", "start", "end", "label", "audio_file_name", "snr_db", "noise_pool", "split_group",
        _round(signal.peak("mixed"), 2, "peak"), _round(c.checksum("mixed"), 1, "checksum"),
    )


def pcm_roundtrip(spark: Spark, d: str) -> DataFrame:
    rows = c.signals(spark, d, gain=200000.0).withColumn("back", features.decode_pcm16(features.encode_pcm16("samples")))
    total = F.aggregate("back", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return rows.select(
        "vec_id", total.alias("total"), F.array_min("back").cast("int").alias("low"), F.array_max("back").cast("int").alias("high"),
        F.size("back").alias("n"),
    )


def _wavs(spark: Spark, d: str) -> DataFrame:
    rows = c.signals(spark, d, rate=16000)
    return rows.select("path", features.wav_bytes(features.encode_pcm16("samples"), F.col("rate")).alias("content"))


def wav_headers(spark: Spark, d: str) -> DataFrame:
    return wav_info(_wavs(spark, d)).select("path", "rate", "channels", "frames", "duration_s")


def decode_audio(spark: Spark, d: str) -> DataFrame:
    return decode_wavs(_wavs(spark, d)).select("path", "rate", "frames", c.checksum("samples").alias("checksum"))


def filter_label(spark: Spark, d: str) -> DataFrame:
    """Positives, real background and external background, as the training draw tells them apart."""
    rows = c.events(spark, d).select("event_id", c.event_label().alias("label"), c.event_pool().alias("noise_pool"))
    sides = {
        "positive": scalars.filter_label(rows, "background", negate=True), "real": scalars.filter_label(rows, "background", external=False),
        "external": scalars.filter_label(rows, "background", external=True),
    }
    parts = [df.select("event_id", F.lit(side).alias("side")) for side, df in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def annotations_roundtrip(spark: Spark, d: str) -> DataFrame:
    """Annotations written as CSV and read back: quotes, commas, line feeds, numbers and missing values."""
    rows = c.events(spark, d).select(
        F.col("event_id").cast("string").alias("annotation_id"), F.col("user_id").cast("string").alias("file_id"),
        (F.col("start_ms") / 1000.0).alias("start"), F.when(F.col("value") < 50, F.col("value")).alias("end"), c.event_label().alias("label"),
        F.concat(F.lit("user "), "user_id", F.lit(', "'), "event_type", F.lit('".wav')).alias("audio_file_name"),
        F.concat(F.lit("s3://media/"), "event_type", F.lit("?a=1,2")).alias("remote_audio_path"),
    )
    folder = work_dir(spark, "annotations")
    sinks.write_annotations(rows, folder)
    return tables.read_annotations(spark, folder)


def features_roundtrip(spark: Spark, d: str) -> DataFrame:
    """Vectors written by label; only the folders of labels 1 and 3 are read."""
    rows = c.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("label"), F.col("embedding").alias("mfcc_features"))
    folder = work_dir(spark, "features")
    sinks.write_features(rows.repartition("label"), folder, partition_by="label")
    back = tables.read_features(spark, folder, labels=["label_1", "label_3"])
    return back.select("vec_id", "label", F.round(c.checksum("mfcc_features"), 5).alias("checksum"))


def file_roundtrip(spark: Spark, d: str) -> DataFrame:
    """Every vector written as a WAV file, its header read by ranges and its samples read back."""
    pcm = c.signals(spark, d).select(F.concat("path", F.lit(".wav")).alias("audio_file_name"), features.encode_pcm16("samples").alias("pcm"))
    folder = work_dir(spark, "wavs")
    sinks.write_wav(pcm, folder)
    stem = F.regexp_extract("path", r"vec_(\d+)\.wav$", 1).cast("bigint").alias("vec_id")
    info = audio_info(spark, folder).select(stem, "rate", "channels", "frames")
    back = scan_audio(spark, folder).select(stem, c.checksum("samples").alias("checksum"))
    return info.join(back, "vec_id")


def archive_roundtrip(spark: Spark, d: str) -> DataFrame:
    """A zip archive of WAV files for each label, published, and read back by tasks that share archives."""
    wavs = c.signals(spark, d).select(
        F.col("label").alias("label"), F.concat("path", F.lit(".wav")).alias("name"),
        features.wav_bytes(features.encode_pcm16("samples"), F.lit(16000)).alias("content"),
    )

    def pack(group):
        import pandas as pd

        group = group.sort_values("name")
        return pd.DataFrame({"name": [f"pool_{group['label'].iloc[0]}.zip"], "content": [folders.zipped(group["name"], group["content"])]})

    folder = work_dir(spark, "archives")
    # an archive is one file and so one group; the largest label bounds it
    folders.publish(wavs.groupBy("label").applyInPandas(pack, "name string, content binary"), folder)
    found = folders.members(spark, folder, ".wav", 4096)
    decoded = decode_wavs(found.select(F.concat_ws("/", "archive", "path").alias("path"), "content"))
    return decoded.select(
        F.regexp_extract("path", r"pool_(\d+)\.zip", 1).cast("int").alias("label"), F.regexp_extract("path", r"vec_(\d+)\.wav$", 1).cast("bigint").alias("vec_id"),
        "rate", "frames", c.checksum("samples").alias("checksum"),
    )


def resample(spark: Spark, d: str) -> DataFrame:
    out = features.resample(c.signals(spark, d, rate=24000, gain=1.0).select("vec_id", "rate", "frames", "samples"), 16000)
    return out.select("vec_id", "rate", "frames", _round(c.checksum("samples"), 5, "checksum"))


def room_response(spark: Spark, d: str) -> DataFrame:
    out = features.room_response(c.signals(spark, d).select("vec_id", "rate", "samples"), [1.0, 0.5, 0.25, 0.125])
    return out.select("vec_id", _round(signal.peak("samples"), 2, "peak"), _round(c.checksum("samples"), 1, "checksum"))


# --------------------------------------------------------------------------------------- spectra

N_FFT, HOP = 32, 8


def _audio(spark: Spark, d: str) -> DataFrame:
    return c.signals(spark, d, rate=16000).select("vec_id", "path", "rate", "frames", "samples")


def _cells(df: DataFrame, column: str, digits: int, value: str) -> DataFrame:
    """One row per coefficient and frame."""
    return df.select("vec_id", F.posexplode(column).alias("row_no", "_row")).select(
        "vec_id", "row_no", F.posexplode("_row").alias("frame_no", "_x")
    ).select("vec_id", "row_no", "frame_no", F.round("_x", digits).alias(value))


def power_spectrum(spark: Spark, d: str) -> DataFrame:
    unit = c.signals(spark, d, rate=16000, gain=1.0).select("vec_id", "rate", "samples")
    return _cells(features.power_spectrum(unit, N_FFT, HOP), "power", 6, "power")


def mfcc(spark: Spark, d: str) -> DataFrame:
    out = features.mfcc(_audio(spark, d).select("vec_id", "rate", "samples"), 5, N_FFT, HOP, n_mels=8, double=True)
    return _cells(out, "mfcc_features", 5, "value")


def mfcc_tiled(spark: Spark, d: str) -> DataFrame:
    """The same in tiles of three frames, of recordings that arrive in runs of 20 samples."""
    runs = _runs(_audio(spark, d), "vec_id", 20)
    out = tiles.mfcc_tiles(runs, "vec_id", 16000, 5, N_FFT, HOP, n_mels=8, frames_per_tile=3)
    return out.select("vec_id", F.col("frame_no").cast("int").alias("frame_no"), F.posexplode("coefficients").alias("row_no", "v")).select(
        "vec_id", "row_no", "frame_no", _round("v", 5, "value")
    )


def _runs(audio: DataFrame, key: str, n: int) -> DataFrame:
    """Recordings cut into runs of ``n`` samples, with their starts."""
    starts = F.sequence(F.lit(0), F.size("samples") - 1, F.lit(n))
    run = F.transform(starts, lambda s: F.struct(s.cast("bigint").alias("start"), F.slice("samples", s + 1, F.lit(n)).alias("samples")))
    return audio.where(F.size("samples") > 0).select(key, F.explode(run).alias("r")).select(key, "r.*")


def pcm_ncc(spark: Spark, d: str) -> DataFrame:
    """All vectors of a label as one recording against the first vector, in tiles narrower and wider than that."""
    signals = c.signals(spark, d).where(F.size("samples") > 0).withColumn("samples", features.decode_pcm16(features.encode_pcm16("samples")))
    first = signals.orderBy("vec_id").select("samples").first().samples
    numbered = ordered.with_ordinal(signals.select("label", "vec_id", "samples"), ["label"], ["vec_id"], 65536, "seq")
    runs = numbered.select("label", ((F.col("seq") - 1) * F.size("samples")).cast("bigint").alias("start"), F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    runs = materialize(runs, "runs")
    template = [x / 32768.0 for x in first]
    found = [tiles.ncc_tiles(runs, "label", template, w, 32768.0).select("label", F.lit(w).alias("width"), _round("score", 6, "score")) for w in (17, 64, 1000)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def template_trim(spark: Spark, d: str) -> DataFrame:
    """The most energetic 32 samples of every vector, faded, with many ties; 64 samples leave it whole."""
    signals = c.signals(spark, d, gain=8.0).select("vec_id", F.transform("samples", lambda x: (x.cast("int")).cast("double")).alias("samples"))
    out = [detect.energetic_window(signals, "vec_id", "samples", n).withColumn("n", F.lit(n)) for n in (32, 64)]
    return out[0].unionByName(out[1]).select("vec_id", "n", "start", "stop", F.size("window").alias("n_samples"), _round(c.checksum("window"), 6, "checksum"))


def mfcc_deltas(spark: Spark, d: str) -> DataFrame:
    out = features.mfcc(_audio(spark, d).select("vec_id", "rate", "samples"), 2, N_FFT, 4, n_mels=8, deltas=True, double=True)
    return _cells(out, "mfcc_features", 5, "value")


def spectral_features(spark: Spark, d: str) -> DataFrame:
    out = features.spectral_features(_audio(spark, d).select("vec_id", "rate", "samples"), N_FFT, HOP)
    return _cells(out, "spectral_features", 4, "value")


def attach_features(spark: Spark, d: str) -> DataFrame:
    """Windows of 32 samples over every recording, joined to its power frames after indexing."""
    audio = c.signals(spark, d, rate=1000, gain=1.0)
    table = features.power_spectrum(audio.select("path", "rate", "samples"), N_FFT, 2).withColumnRenamed("power", "features")
    index = intervals.slide_windows(
        audio.select("vec_id", "path", F.lit(0).cast("bigint").alias("start_ms"), F.col("frames").alias("end_ms")), 32, 8
    )
    cut = lookups.attach_features(index, table, "path", frames_per_tile=16, rate=1000, hop=2)
    flat = scalars.flatten_features(F.col("mfcc_features"))
    return cut.select("vec_id", "chunk_start", F.size(flat).alias("n_features"), _round(c.checksum(flat), 3, "checksum"))


# ------------------------------------------------------------------------------ series detection


def energetic_window(spark: Spark, d: str) -> DataFrame:
    out = detect.energetic_series(c.numbered_events(spark, d), "user_id", "seq", "value", 8, digits=6)
    return out.select("user_id", "start", "stop", _round("energy", 4, "energy"))


def _template(spark: Spark, d: str, user: int, n: int = 8) -> list[float]:
    """The first ``n`` values of one user: a template is a short, fixed-length array."""
    first = c.events(spark, d).filter(F.col("user_id") == user).orderBy("start_ms", "event_id").limit(n)
    return [row["value"] for row in first.collect()]


def ncc_score(spark: Spark, d: str) -> DataFrame:
    out = detect.ncc_series(c.numbered_events(spark, d), "user_id", "seq", "value", _template(spark, d, 0))
    return out.select("user_id", _round("score", 9, "score"))


def multi_template(spark: Spark, d: str) -> DataFrame:
    """Best score over the openings of users 0, 1 and 2."""
    templates = {user: _template(spark, d, user) for user in (0, 1, 2)}
    return detect.best_template_series(c.numbered_events(spark, d), "user_id", "seq", "value", templates)


def energy_score(spark: Spark, d: str) -> DataFrame:
    """RMS of the last four values of the user, the template-free trigger."""
    rolled = ordered.rolling_context(c.numbered_events(spark, d), ["user_id"], "seq", "value", 2.0, 0.5)
    return rolled.select("event_id", F.size("context").alias("n_context"), _round(signal.rms("context"), 6, "score"))


def _detections(spark: Spark, d: str) -> DataFrame:
    return detect.detections(c.numbered_events(spark, d), "user_id", "start_ms", "event_id", 0.2, 240 * c.HOUR)


def cooldown_detections(spark: Spark, d: str) -> DataFrame:
    rows = c.scored_events(spark, d)
    return detect.detections(rows, "user_id", "start_ms", "event_id", 0.2, 240 * c.HOUR).select("event_id", "user_id", "start_ms")


def clip_context(spark: Spark, d: str) -> DataFrame:
    found = _detections(spark, d).select("user_id", F.col("seq").alias("trigger_seq"))
    chunks = c.numbered_events(spark, d).select("user_id", "seq", "event_id", "value")
    return lookups.clip_context(found, chunks, 6, 12, key="user_id").select("user_id", "trigger_seq", "seq", "event_id")


def clip_assembly(spark: Spark, d: str) -> DataFrame:
    found = _detections(spark, d).select("user_id", F.col("seq").alias("trigger_seq"))
    chunks = c.numbered_events(spark, d).select("user_id", "seq", "value")
    clips = lookups.assemble_clips(lookups.clip_context(found, chunks, 6, 12, key="user_id"), value="value", key="user_id")
    return clips.select("user_id", "trigger_seq", "n_pre", "n_post", _round(c.checksum("frames"), 4, "checksum"))


def throttle_warmup(spark: Spark, d: str) -> DataFrame:
    """Drop three events after every error (a stream reset), then keep every second."""
    rows = c.events(spark, d)
    ready = ordered.warm_up(rows, ["user_id"], ["start_ms", "event_id"], c.SEGMENT_MS, 3, F.col("event_type") == "error")
    return ordered.throttle(ready, 2, skipped=3).select("event_id", "user_id", "session", "position")


def k_of_n_vote(spark: Spark, d: str) -> DataFrame:
    clips = c.scored_events(spark, d).withColumn("clip", F.concat_ws("@", F.col("user_id").cast("string"), F.floor(F.col("start_ms") / c.DAY).cast("string")))
    return detect.k_of_n_vote(clips, "clip", F.col("score") > 0.1, k=2)


def stale_devices(spark: Spark, d: str) -> DataFrame:
    rows = c.events(spark, d)
    now = rows.agg(F.max("start_ms")).scalar()
    return detect.stale_devices(rows, "user_id", "start_ms", now, 12 * c.HOUR)


def uncertain_rows(spark: Spark, d: str) -> DataFrame:
    return detect.uncertain_rows(c.scored_events(spark, d), "score").select("event_id", _round("score", 9, "score"))


# -------------------------------------------------------------------------------------- reports


def class_report(spark: Spark, d: str) -> DataFrame:
    report = metrics.class_report(c.table(spark, d, "labels"), "quality", "toxic")
    return report.select("class", *[_round(m, 9, m) for m in ("precision", "recall", "f1")], "support")


def weighted_report(spark: Spark, d: str) -> DataFrame:
    report = metrics.weighted_report(c.table(spark, d, "labels"), "quality", "toxic")
    return report.select(*[_round(m, 9, m) for m in ("precision", "recall", "f1")], "support")


def confusion_matrix(spark: Spark, d: str) -> DataFrame:
    return metrics.confusion_matrix(c.table(spark, d, "labels"), "quality", "toxic", [0, 1])


def fingerprint(spark: Spark, d: str) -> DataFrame:
    return metrics.dataset_fingerprint(c.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


BATCH = {
    f.__name__: f
    for f in (
        balanced_windows, normalize_uri, explode_annotations, default_annotation, fill_and_group, slide_windows,
        count_per_label, label_distribution, positive_total, quality_metrics, sync_plan, name_difference, distinct_first,
        exclude_values, resolve_first, sample_n, split_draw, balance, background_shortfall, shuffle_rank, group_split,
        leakage_check, split_shape, sample_power, circular_shift, mix_at_snr, gain_jitter, index_windows, index_pool,
        extract_windows, pool_rows, draw_noise, augment, pcm_roundtrip, wav_headers, decode_audio, filter_label, annotations_roundtrip, features_roundtrip, file_roundtrip, archive_roundtrip, resample, room_response,
        power_spectrum, mfcc, mfcc_tiled, mfcc_deltas, pcm_ncc, template_trim, spectral_features, attach_features, energetic_window, ncc_score,
        multi_template, energy_score, cooldown_detections, clip_context, clip_assembly, throttle_warmup, k_of_n_vote,
        stale_devices, uncertain_rows, class_report, weighted_report, confusion_matrix, fingerprint,
    )
}
