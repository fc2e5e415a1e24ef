"""Sample arithmetic, spectra, audio sources and sinks."""

import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.functions import pcm as kernels
from sonarium.functions import signal
from sonarium.operators import features, intervals, lookups, noise
from sonarium.sources import audio, sinks, tables


def wav(path, samples, rate=16000, channels=1):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(np.asarray(samples, dtype="<i2").tobytes())


def _frame(spark, arrays, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in a], *[columns[n][i] for n in names]) for i, a in enumerate(arrays)]
    types = "".join(f", {n} {'int' if isinstance(columns[n][0], int) else 'double'}" for n in names)
    return spark.createDataFrame(rows, "id int, samples array<double>" + types)


def test_mix_reaches_snr_and_never_clips(spark):
    rng = np.random.default_rng(0)
    s, n = rng.normal(0, 900, 400), rng.normal(0, 40, 400)
    rows = [(snr, s.tolist(), n.tolist()) for snr in (-5, 0, 5, 10, 15)]
    df = spark.createDataFrame(rows, "snr int, s array<double>, n array<double>")
    for r in df.select("snr", signal.mix_at_snr("s", "n", F.col("snr")).alias("m")).collect():
        mixed = np.array(r.m)
        added = mixed - s
        assert 10 * np.log10(np.mean(s**2) / np.mean(added**2)) == pytest.approx(r.snr, abs=0.1)
        assert np.allclose(mixed, kernels.mix(s, n, r.snr, 0.0))
    loud = spark.createDataFrame([((s * 30).tolist(), (n * 500).tolist())], "s array<double>, n array<double>")
    peak = loud.select(signal.peak(signal.mix_at_snr("s", "n", F.lit(0)))).first()[0]
    assert peak == pytest.approx(32767)
    quiet = spark.createDataFrame([([3.0, -4.0], [0.0, 0.0])], "s array<double>, n array<double>")
    assert quiet.select(signal.mix_at_snr("s", "n", F.lit(0))).first()[0] == [3.0, -4.0]


def test_shift_gain_and_crossings(spark):
    df = _frame(spark, [[1, 2, 3, 4], [30000, -5, 0, 2]])
    for k in (0, 1, 3, 4, 9):
        got = [r[0] for r in df.orderBy("id").select(signal.circular_shift("samples", F.lit(k))).collect()]
        assert got[0] == np.roll([1, 2, 3, 4], k).tolist()
    gained = df.orderBy("id").select(signal.apply_gain("samples", F.lit(6.0)).alias("g")).collect()
    assert np.allclose(gained[0].g, np.array([1, 2, 3, 4]) * 10 ** 0.3)
    assert np.allclose(gained[1].g, np.array([30000, -5, 0, 2]) * 32767 / 30000)
    assert [r[0] for r in df.orderBy("id").select(signal.zero_crossings("samples")).collect()] == [0.0, 0.5]
    assert df.orderBy("id").select(signal.rms("samples")).first()[0] == pytest.approx(np.sqrt(7.5))


def test_pcm_codec(spark):
    df = _frame(spark, [[1.9, -1.9, 40000, -40000]])
    assert df.select(features.decode_pcm16(features.encode_pcm16("samples"))).first()[0] == [1, -1, 32767, -32768]


def test_resample_length_and_tone(spark):
    t = np.arange(2 * 44100) / 44100
    df = _frame(spark, [np.sin(2 * np.pi * 440 * t) * 16384, np.ones(16000)], rate=[44100, 16000])
    rows = features.resample(df.withColumn("frames", F.size("samples").cast("bigint"))).orderBy("id").collect()
    assert [r.frames for r in rows] == [32000, 16000] and {r.rate for r in rows} == {16000}
    want = np.sin(2 * np.pi * 440 * np.arange(32000) / 16000) * 16384
    assert np.abs(np.array(rows[0].samples)[200:-200] - want[200:-200]).max() < 40
    for rate in (8000, 22050, 48000, 24000):
        x = np.random.default_rng(rate).normal(size=1000)
        y = kernels.resample(x, rate)
        g = np.gcd(rate, 16000)
        up, down = 16000 // g, rate // g
        half = 10 * max(up, down)
        n = np.arange(-half, half + 1)
        h = np.sinc(n / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
        h *= up / h.sum()
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        direct = np.convolve(stuffed, h)[half:][::down][: -(-len(x) * up // down)]
        assert np.allclose(y, direct)


def _plain_mfcc(y, rate, n_mfcc, n_fft, hop, n_mels):
    """Textbook loops, independent of the vectorised helper."""
    pad = np.concatenate([np.zeros(n_fft // 2), y, np.zeros(n_fft // 2)])
    win = [0.5 - 0.5 * np.cos(2 * np.pi * i / n_fft) for i in range(n_fft)]
    cols = []
    for start in range(0, len(y) // hop * hop + 1, hop):
        cols.append(np.abs(np.fft.fft(pad[start : start + n_fft] * win)[: n_fft // 2 + 1]) ** 2)
    power = np.array(cols).T

    def to_mel(f):
        return f * 3 / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)

    def to_hz(m):
        return m * 200 / 3 if m < 15 else 1000 * np.exp((m - 15) * np.log(6.4) / 27)

    pts = [to_hz(to_mel(rate / 2) * i / (n_mels + 1)) for i in range(n_mels + 2)]
    bank = np.zeros((n_mels, n_fft // 2 + 1))
    for m in range(n_mels):
        for k in range(n_fft // 2 + 1):
            f = k * rate / n_fft
            tri = min((f - pts[m]) / (pts[m + 1] - pts[m]), (pts[m + 2] - f) / (pts[m + 2] - pts[m + 1]))
            bank[m, k] = max(0.0, tri) * 2 / (pts[m + 2] - pts[m])
    db = 10 * np.log10(np.maximum(bank @ power, 1e-10))
    db = np.maximum(db, db.max() - 80)
    out = np.zeros((n_mfcc, db.shape[1]))
    for c in range(n_mfcc):
        for m in range(n_mels):
            out[c] += db[m] * np.cos(np.pi * c * (2 * m + 1) / (2 * n_mels))
        out[c] *= np.sqrt((1 if c == 0 else 2) / n_mels)
    return out


def test_mfcc(spark):
    rng = np.random.default_rng(5)
    y = np.round(4000 * np.sin(2 * np.pi * 700 * np.arange(9000) / 16000) + rng.normal(0, 200, 9000))
    df = _frame(spark, [y, np.zeros(600)], rate=[16000, 16000])
    rows = features.mfcc(df).orderBy("id").collect()
    got = np.array(rows[0].mfcc_features)
    assert got.shape == (13, 1 + 9000 // 512)
    assert np.allclose(got, _plain_mfcc(y, 16000, 13, 512, 512, 128), rtol=1e-4, atol=1e-3)
    assert np.allclose(np.array(rows[1].mfcc_features)[1:], 0, atol=1e-3)
    for bad in (-1, 0):
        with pytest.raises(ValueError):
            features.mfcc(df, n_fft=bad)


def test_deltas_and_shape():
    x = np.vstack([3.0 * np.arange(20.0), np.arange(20.0) ** 2])
    assert np.allclose(kernels.delta(x, 1)[0], 3.0)
    assert np.allclose(kernels.delta(x, 2)[1], 2.0)
    with pytest.raises(ValueError):
        kernels.delta(x[:, :8])
    tone = np.sin(2 * np.pi * 1000 * np.arange(8000) / 16000)
    centroid, bandwidth, rolloff = kernels.spectral_shape(tone, 16000, 512, 512)[:, 5]
    assert centroid == pytest.approx(1000, abs=40) and rolloff == pytest.approx(1000, abs=63) and bandwidth < 200


def test_stretch_keeps_pitch_and_room_response():
    tone = 1000 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    for speed in (0.9, 1.1):
        out = kernels.stretch(tone, speed)
        assert len(out) == round(16000 / speed)
        middle = out[4000 : 4000 + 8192] * np.hanning(8192)
        assert np.abs(np.fft.rfft(middle)).argmax() * 16000 / 8192 == pytest.approx(440, abs=4)
    assert np.allclose(kernels.convolve(np.array([1.0, 0, 0, 2.0]), np.array([1.0, 0.5])), [1, 0.5, 0, 2])


def test_scan_info_and_errors(spark, tmp_path):
    rng = np.random.default_rng(1)
    mono = rng.integers(-3000, 3000, 16000)
    wav(tmp_path / "a.wav", mono)
    wav(tmp_path / "b.wav", np.stack([mono, mono + 3], axis=1).ravel(), rate=44100, channels=2)
    (tmp_path / "notes.txt").write_text("skip me")
    info = {r.path.rsplit("/", 1)[-1]: r for r in audio.audio_info(spark, str(tmp_path)).collect()}
    assert (info["a.wav"].rate, info["a.wav"].frames, info["a.wav"].duration_s) == (16000, 16000, 1.0)
    assert (info["b.wav"].channels, info["b.wav"].frames) == (2, 16000)
    got = {r.path.rsplit("/", 1)[-1]: np.array(r.samples) for r in audio.scan_audio(spark, str(tmp_path)).collect()}
    assert np.array_equal(got["a.wav"], mono) and np.array_equal(got["b.wav"], np.floor(mono + 1.5))
    with pytest.raises(Exception, match="[Pp]ath"):
        audio.scan_audio(spark, str(tmp_path / "missing")).collect()
    rows = intervals.pool_rows(audio.audio_info(spark, str(tmp_path)), F.lit("ext")).orderBy("audio_file_name").collect()
    assert [(r.annotation_id, r.start, r.end, r.label) for r in rows] == [
        ("noise_ext_a", 0.0, None, "background"), ("noise_ext_b", 0.0, None, "background")
    ]


def test_archive(spark, tmp_path):
    one = io.BytesIO()
    with wave.open(one, "wb") as out:
        out.setnchannels(1), out.setsampwidth(2), out.setframerate(16000)
        out.writeframes(np.arange(100, dtype="<i2").tobytes())
    with zipfile.ZipFile(tmp_path / "pool.zip", "w") as z:
        for name in ("a", "b", "c"):
            z.writestr(f"root/audio/{name}.wav", one.getvalue())
        z.writestr("root/meta.csv", "filename,category\na.wav,church\nb.wav,vacuum\nc.wav,rain\n")
    meta = audio.archive_table(spark, str(tmp_path), "meta.csv", "filename string, category string")
    keep = lookups.exclude_values(meta, "category", ["church"])
    members = audio.scan_audio_archive(spark, str(tmp_path), keep, partitions=2)
    decoded = audio.decode_wavs(members).collect()
    assert sorted(r.path for r in decoded) == ["root/audio/b.wav", "root/audio/c.wav"]
    assert all(r.frames == 100 for r in decoded)


def test_write_wav_copy_and_template(spark, tmp_path):
    rows = [("full.wav", np.arange(8000, dtype="<i2").tobytes()), ("empty.wav", b"")]
    df = spark.createDataFrame(rows, "audio_file_name string, pcm binary")
    done = {r.path.rsplit("/", 1)[-1]: r for r in sinks.write_wav(df, str(tmp_path / "clips")).collect()}
    assert done["full.wav"].status == "written" and done["full.wav"].frames == 8000
    heads = {r.path.rsplit("/", 1)[-1]: (r.rate, r.channels, r.frames) for r in audio.audio_info(spark, str(tmp_path / "clips")).collect()}
    assert heads == {"full.wav": (16000, 1, 8000), "empty.wav": (16000, 1, 0)}
    (tmp_path / "blocked").write_text("a file, not a folder")
    failed = sinks.write_wav(df, str(tmp_path / "blocked")).collect()
    assert all(r.status.startswith("failed") for r in failed)

    want = spark.createDataFrame([("full.wav", "s3://m/full.wav")], "audio_file_name string, remote_audio_path string")
    have = spark.createDataFrame([("old.wav",)], "audio_file_name string")
    plan = lookups.sync_plan(want, have)
    copied = sinks.copy_missing(plan, audio.list_files(spark, str(tmp_path / "clips")), str(tmp_path / "local")).collect()
    assert [r.status for r in copied] == ["written"]
    assert sorted(p.name for p in (tmp_path / "local").iterdir()) == ["full.wav"]

    template = audio.load_template(spark, str(tmp_path / "clips" / "full.wav"))
    assert len(template) == 8000 and template[100] == pytest.approx(100 / 32768)


def test_extract_and_attach(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = {"a.wav": rng.integers(-900, 900, 80000), "b.wav": rng.integers(-900, 900, 40000)}
    for name, values in data.items():
        wav(tmp_path / name, values)
    files = audio.list_files(spark, str(tmp_path))
    index = intervals.index_pool(audio.wav_info(files), 2000, 250).select("path", "start_sample", "length")
    rows = lookups.attach_samples(index, audio.decode_wavs(files), 32000).collect()
    assert len(rows) == 12 + len(range(0, 500, 250))
    for r in rows:
        assert r.window == data[r.path.rsplit("/", 1)[-1]][r.start_sample : r.start_sample + 32000].tolist()


def test_attach_features(spark):
    feats = np.arange(3 * 700, dtype=float).reshape(3, 700)
    table = spark.createDataFrame([("a", feats.tolist())], "audio_file_name string, features array<array<double>>")
    starts = [0, 250, 1999, 8000, 19750]
    chunks = spark.createDataFrame([("a", s, s + 2000) for s in starts], "audio_file_name string, chunk_start long, chunk_end long")
    for r in lookups.attach_features(chunks, table, frames_per_tile=64).collect():
        first = int(0.03125 * r.chunk_start)
        assert np.array_equal(np.array(r.mfcc_features), feats[:, first : first + 62])
    with pytest.raises(Exception, match="wider than a feature tile"):
        lookups.attach_features(chunks, table, frames_per_tile=32).collect()


def test_noise_draw_and_augment(spark):
    rng = np.random.default_rng(3)
    audio_rows = [(f"{p}_{i}", p, 1000, 400, rng.normal(0, 500, 400).tolist()) for p in ("big", "small") for i in range(40 if p == "big" else 2)]
    files = spark.createDataFrame(audio_rows, "path string, noise_pool string, rate int, frames long, samples array<double>")
    spans = files.select("noise_pool", "path", F.lit(0).cast("bigint").alias("start_ms"), F.col("frames").alias("end_ms"), "rate", "frames")
    asked = spark.range(4000)
    draw = noise.draw_noise(asked, "id", spans, ["big", "small"], 100, 50).cache()
    assert draw.count() == 4000
    per_pool = {r.noise_pool: r["count"] for r in draw.groupBy("noise_pool").count().collect()}
    assert abs(per_pool["big"] - 2000) < 150
    small = {(r.path, r.start_sample): r["count"] for r in draw.filter("noise_pool = 'small'").groupBy("path", "start_sample").count().collect()}
    assert len(small) == 2 * len(range(0, 300, 50)) and min(small.values()) > 100
    again = noise.draw_noise(asked.repartition(1), "id", spans.repartition(3), ["big", "small"], 100, 50)
    assert {tuple(r) for r in draw.collect()} == {tuple(r) for r in again.collect()}
    with pytest.raises(Exception, match="no candidate windows: none"):
        noise.draw_noise(asked, "id", spans, ["big", "none"], 100, 50).collect()

    signals = spark.createDataFrame([(1, rng.normal(0, 9000, 100).tolist(), "rec1"), (2, rng.normal(0, 50, 100).tolist(), "rec2")],
                                    "signal_id int, window array<double>, split_group string")
    made = noise.augment(signals, spans, files, ["big", "small"], "bell", 100, 50, rate=1000)
    rows = {r.annotation_id: r for r in made.collect()}
    assert len(rows) == 2 * 5 * 2 and rows["aug_snr-5_2_0"].split_group == "rec2"
    assert all(np.abs(r.mixed).max() <= 32767.0001 for r in rows.values())
    bounds = intervals.with_bounds(made.select("annotation_id", "start", "end"))
    assert intervals.slide_windows(bounds, 100, 50).count() == 20


def test_feature_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", [[1.0]]), ("b", [[2.0]])], "label string, mfcc_features array<array<double>>")
    sinks.write_features(df, str(tmp_path / "f"), partition_by="label")
    assert tables.read_features(spark, str(tmp_path / "f"), ["b"]).first().mfcc_features == [[2.0]]
    sinks.write_metrics_json(spark.createDataFrame([(1, None)], "n int, ratio double"), str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("*.json")).read_text()
    assert text.strip() == '{"n":1,"ratio":null}'


class _Batch:
    """One Arrow batch in place of a DataFrame: what a Python worker hands over for it."""

    def __init__(self, batch, schema=None):
        self.batch, self.schema = batch, schema

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        return list(run(iter([self.batch])))


def test_workers_hand_over_frames_of_some_rows():
    """Neither a frame for every recording nor one for a whole Arrow batch."""
    import pandas as pd
    from pyspark.sql import types as T

    from sonarium.operators import features

    wavs = pd.DataFrame({"path": [str(i) for i in range(1_200)], "content": [kernels.write_wav(b"\1\0" * (i + 1)) for i in range(1_200)]})
    frames = audio.decode_wavs(_Batch(wavs))
    assert [len(f) for f in frames] == [500, 500, 200]
    back = pd.concat(frames)
    assert list(back["frames"]) == list(range(1, 1_201)) and [len(s) for s in back["samples"]] == list(back["frames"])
    rows = pd.DataFrame({"path": wavs["path"], "samples": [np.ones(4_000)] * 1_200, "rate": 16_000})
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("samples", T.ArrayType(T.DoubleType())), T.StructField("rate", T.IntegerType())])
    frames = features.power_spectrum(_Batch(rows, schema), 32, 8)
    sizes = [sum(row.nbytes for made in f["power"] for row in made) for f in frames]
    assert max(sizes) < 2 * features.FRAME_BYTES and list(pd.concat(frames)["path"]) == list(rows["path"])
