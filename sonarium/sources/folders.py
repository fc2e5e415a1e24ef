"""Files as Python data sources: WAV headers by ranged reads, archive members by the archive's directory, and a writer
whose files appear when the whole job has succeeded.

Paths are local or URIs of any file system that Arrow knows; executors read and write them themselves. The driver plans
with names and sizes and publishes by renaming; no content passes through it.
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Content of a task, and of a batch of rows.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Tasks that small members are dealt to at most: beyond, shares grow up to PARTITION_BYTES before there are more.
SHARES = 256
#: Files of a task that only reads headers.
HEADERS = 2_000
RENAMES = 16


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(paths: Sequence[str], glob: str) -> list[tuple[str, int]]:
    """Names and sizes of the files in the folders whose names match; a path may be a file. Hidden ones are left out."""
    found = []
    for path in paths:
        system, place = locate(path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        entries = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place))
        root = path.rstrip("/")
        for e in sorted(entries, key=lambda e: e.path):
            if e.type == fs.FileType.File and fnmatch.fnmatch(e.base_name, glob) and not e.base_name.startswith((".", "_")):
                found.append((root if info.type == fs.FileType.File else f"{root}/{e.base_name}", e.size))
    return found


def _packed(items: Sequence, size, most: int) -> list[list]:
    """Items in runs of about ``most`` bytes."""
    runs, held = [], most
    for item in items:
        if held >= most:
            runs.append([])
            held = 0
        runs[-1].append(item)
        held += size(item)
    return runs


@dataclass
class Share(InputPartition):
    """What one task reads."""

    items: list

    def __init__(self, items: list):
        self.items = items


# ------------------------------------------------------------------------------------ headers


def read_header(file, size: int) -> tuple[int, int, int]:
    """``rate, channels, frames``: walks the chunks of a RIFF file by their lengths, a few bytes of each."""
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate, channels, block = 12, 0, 0, 0
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            _, channels, rate, _, block = struct.unpack("<HHIIH", file.read(14))
        elif name == b"data":
            return rate, channels, min(length, size - at - 8) // block
        at += 8 + length + (length & 1)
    raise ValueError("no data chunk")


class HeaderReader(DataSourceReader):
    def __init__(self, paths: list[str], glob: str):
        self.paths, self.glob = paths, glob

    def partitions(self) -> Sequence[InputPartition]:
        return [Share(run) for run in _packed(listed(self.paths, self.glob), lambda _: 1, HEADERS)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, size in partition.items:
            system, place = locate(path)
            with system.open_input_file(place) as file:
                rate, channels, frames = read_header(file, size)
            yield path, rate, channels, frames, frames / max(rate, 1)


class AudioHeaders(DataSource):
    """``path, rate, channels, frames, duration_s`` of WAV files; ``paths`` is a JSON list of folders or files."""

    @classmethod
    def name(cls) -> str:
        return "audio_headers"

    def schema(self) -> str:
        return "path string, rate int, channels int, frames bigint, duration_s double"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(json.loads(self.options["paths"]), self.options.get("glob", "*.wav"))


# ------------------------------------------------------------------------------------ archives


@dataclass
class Member:
    """Where a member of an archive lies, as the archive's directory says."""

    archive: str
    name: str
    size: int
    offset: int
    packed: int
    method: int
    crc: int
    flags: int


def read_member(file, member: Member) -> bytes:
    """The content of a stored or deflated member, from its own bytes alone; other kinds go by the whole directory."""
    if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or member.flags & 1:
        with zipfile.ZipFile(file) as archive:
            return archive.read(member.name)
    file.seek(member.offset)
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile(f"no member at the place of {member.name!r}")
    file.seek(member.offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    content = file.read(member.packed)
    if member.method == zipfile.ZIP_DEFLATED:
        content = zlib.decompress(content, -zlib.MAX_WBITS)
    if len(content) != member.size or zlib.crc32(content) != member.crc:
        raise zipfile.BadZipFile(f"bad content of {member.name!r}")
    return content


class MemberReader(DataSourceReader):
    """Members of zip archives, dealt to tasks by size: several tasks may read one archive. Its directory is read once, by
    the plan; a task reads the bytes of its members only."""

    def __init__(self, paths: list[str], suffix: str, most: int):
        self.paths, self.suffix, self.most = paths, suffix, most

    def partitions(self) -> Sequence[InputPartition]:
        members = []
        for path, _ in listed(self.paths, "*.zip"):
            system, place = locate(path)
            with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
                members += [
                    Member(path, m.filename, m.file_size, m.header_offset, m.compress_size, m.compress_type, m.CRC, m.flag_bits)
                    for m in archive.infolist() if m.filename.endswith(self.suffix) and not m.is_dir()
                ]
        most = max(self.most, min(PARTITION_BYTES, sum(m.size for m in members) // SHARES))
        return [Share(run) for run in _packed(members, lambda m: m.size, most)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for run in _packed(partition.items, lambda m: m.size, BATCH_BYTES):
            contents, opened, file = [], None, None
            for member in run:
                if opened != member.archive:
                    if file:
                        file.close()
                    system, place = locate(member.archive)
                    opened, file = member.archive, system.open_input_file(place)
                contents.append(read_member(file, member))
            file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.archive for m in run]), pa.array([m.name for m in run]), pa.array(contents, pa.binary())], names=["archive", "path", "content"]
            )


class ArchiveMembers(DataSource):
    """``archive, path, content`` of the members of zip archives with a suffix."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(json.loads(self.options["paths"]), self.options.get("suffix", ""), int(self.options.get("partition_bytes", PARTITION_BYTES)))


# ------------------------------------------------------------------------------------ writer


@dataclass
class Staged(WriterCommitMessage):
    """Where one task has left its files."""

    folder: str
    names: list[str]


class FolderWriter(DataSourceArrowWriter):
    """Tasks write below a hidden folder; the driver moves what successful tasks name into place, or nothing."""

    def __init__(self, path: str):
        self.path, self.job = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, place = locate(self.path)
        task = TaskContext.get()
        folder, names = f"{place}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}", []
        system.create_dir(folder)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"not a file name: {name!r}")
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = locate(self.path)
        moves = [(f"{m.folder}/{name}", f"{place}/{name}") for m in messages if m for name in m.names]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have one file name; nothing was published")
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda move: system.move(*move), moves))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Drops the hidden folder with what is left in it; a task that still runs may make it anew, hidden as before."""
        system, place = locate(self.path)
        if system.get_file_info(f"{place}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{place}/{self.job}")


class FolderFiles(DataSource):
    """A folder of files, to write ``name, content`` rows to; files of the same names are replaced."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FolderWriter(self.options["path"])


# ------------------------------------------------------------------------------------ for callers


def headers(spark: SparkSession, paths: Sequence[str] | str, glob: str = "*.wav") -> DataFrame:
    spark.dataSource.register(AudioHeaders)
    found = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("audio_headers").option("paths", json.dumps(found)).option("glob", glob).load()


def members(spark: SparkSession, paths: Sequence[str] | str, suffix: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    found = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format("archive_members").option("paths", json.dumps(found)).option("suffix", suffix)
    return reader.option("partition_bytes", partition_bytes).load()


def publish(rows: DataFrame, path: str) -> None:
    """Write ``name, content`` rows as files that appear together, or, if a task fails for good, not at all."""
    rows.sparkSession.dataSource.register(FolderFiles)
    rows.select("name", "content").write.format("folder_files").option("path", path).mode("append").save()


def zipped(names: Sequence[str], contents: Sequence[bytes]) -> bytes:
    """A zip archive of a few small files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in zip(names, contents):
            archive.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()
