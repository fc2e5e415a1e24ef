"""Files as data sources: ranged headers, shared archives, all-or-nothing writes."""

import io
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonarium.functions import pcm as kernels
from sonarium.sources import audio, folders, sinks


def wav(n, rate=8000, extra=b""):
    data = np.arange(n, dtype="<i2").tobytes()
    chunk = b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) & 1) if extra else b""
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
    body = b"WAVE" + head + chunk + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_header_takes_a_few_bytes():
    content = wav(400_000, extra=b"x" * 9_999)  # the samples begin behind a long chunk
    file = Counting(content)
    assert folders.read_header(file, len(content)) == (8000, 1, 400_000) == kernels.wav_header(content)
    assert file.taken < 100
    with pytest.raises(ValueError, match="RIFF"):
        folders.read_header(io.BytesIO(b"no sound at all"), 15)
    with pytest.raises(ValueError, match="data"):
        folders.read_header(io.BytesIO(content[:40]), 40)


def test_headers_of_folders(spark, tmp_path):
    for name, n in (("a.wav", 80), ("b.wav", 16000), ("c.txt", 1), (".d.wav", 5)):
        (tmp_path / name).write_bytes(wav(n))
    got = {os.path.basename(r.path): (r.rate, r.channels, r.frames, r.duration_s) for r in audio.audio_info(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": (8000, 1, 80, 0.01), "b.wav": (8000, 1, 16000, 2.0)}
    assert audio.audio_info(spark, [f"file://{tmp_path}/a.wav"]).first().path.endswith("a.wav")
    (tmp_path / "empty").mkdir()
    assert audio.audio_info(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        audio.audio_info(spark, str(tmp_path / "nowhere")).count()


def test_tasks_share_an_archive(spark, tmp_path):
    names = [f"pool/n{i}.wav" for i in range(12)] + ["pool/notes.csv"]
    contents = [wav(100 + i) for i in range(12)] + [b"filename,kind\nn3.wav,a\nn5.wav,b\n"]
    (tmp_path / "one.zip").write_bytes(folders.zipped(names, contents))
    members = folders.members(spark, str(tmp_path), ".wav", partition_bytes=600)
    tasks = members.select("path", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in tasks}) >= 4 and sorted(r.path for r in tasks) == sorted(names[:-1])
    assert {r.path: bytes(r.content) for r in members.collect()} == dict(zip(names[:-1], contents[:-1]))
    listed = audio.archive_table(spark, str(tmp_path), "notes.csv", "filename string, kind string")
    assert {tuple(r) for r in listed.collect()} == {("n3.wav", "a"), ("n5.wav", "b")}
    kept = audio.scan_audio_archive(spark, str(tmp_path), listed)
    assert sorted(r.path for r in kept.collect()) == ["pool/n3.wav", "pool/n5.wav"]


def seen(folder):
    """Visible files; a task that was still running when the job failed may leave a hidden folder."""
    return sorted(n for n in os.listdir(folder) if not n.startswith("_")) if folder.exists() else []


def test_files_appear_together(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}.bin", bytes([i]) * i) for i in range(20)], "name string, content binary").repartition(5)
    folders.publish(rows, str(tmp_path / "out"))
    assert seen(tmp_path / "out") == sorted(f"f{i}.bin" for i in range(20))
    assert all((tmp_path / "out" / f"f{i}.bin").read_bytes() == bytes([i]) * i for i in range(20))
    folders.publish(rows.where("name = 'f3.bin'").withColumn("content", F.lit(b"new")), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "f3.bin").read_bytes() == b"new" and len(seen(tmp_path / "out")) == 20


@pytest.mark.parametrize("bad", ["a/b", "", None])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    rows = [(f"f{i}.bin", b"x") for i in range(20)] + [(bad, b"x")]
    with pytest.raises(Exception, match="not a file name"):
        folders.publish(spark.createDataFrame(rows, "name string, content binary").repartition(6), str(tmp_path / "out"))
    assert seen(tmp_path / "out") == []


def test_equal_names_publish_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("a", b"2"), ("b", b"3")], "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="one file name"):
        folders.publish(rows, str(tmp_path / "out"))
    assert seen(tmp_path / "out") == []


def test_wavs_and_copies(spark, tmp_path):
    pcm = [np.arange(n, dtype="<i2").tobytes() for n in (3, 500)]
    rows = spark.createDataFrame(pd.DataFrame({"audio_file_name": ["x.wav", "y.wav"], "pcm": pcm}))
    log = {os.path.basename(r.path): r.frames for r in sinks.write_wav(rows, str(tmp_path / "w")).collect()}
    assert log == {"x.wav": 3, "y.wav": 500}
    back = {os.path.basename(r.path): r.samples for r in audio.scan_audio(spark, str(tmp_path / "w")).collect()}
    assert back == {"x.wav": [0, 1, 2], "y.wav": list(range(500))}
    plan = spark.createDataFrame([("y.wav", "fetch"), ("x.wav", "keep")], "audio_file_name string, action string")
    copied = sinks.copy_missing(plan, audio.list_files(spark, str(tmp_path / "w")), str(tmp_path / "c")).collect()
    assert [os.path.basename(r.path) for r in copied] == ["y.wav"] == seen(tmp_path / "c") and copied[0].bytes == 1044


def test_member_is_read_without_the_directory():
    """A task takes the bytes of its member only, however many others the archive has."""
    names = [f"{i}.wav" for i in range(2_000)]
    content = folders.zipped(names, [bytes([i % 251]) * (i + 1) for i in range(2_000)])
    with folders.zipfile.ZipFile(io.BytesIO(content)) as archive:
        m = archive.getinfo("1234.wav")
    member = folders.Member("a.zip", m.filename, m.file_size, m.header_offset, m.compress_size, m.compress_type, m.CRC, m.flag_bits)
    file = Counting(content)
    assert folders.read_member(file, member) == bytes([1234 % 251]) * 1235
    assert file.taken == 30 + m.compress_size
    with pytest.raises(folders.zipfile.BadZipFile):
        folders.read_member(io.BytesIO(content), folders.Member(**{**vars(member), "crc": 1}))


def test_small_members_make_a_bounded_number_of_tasks(tmp_path):
    names = [f"{i}.wav" for i in range(5_000)]
    (tmp_path / "a.zip").write_bytes(folders.zipped(names, [b"x" * 100] * 5_000))
    shares = folders.MemberReader([str(tmp_path)], ".wav", 200).partitions()
    assert len(shares) <= folders.SHARES + 1 and [m.name for s in shares for m in s.items] == names
