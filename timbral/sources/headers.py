"""Audio headers as a Spark data source: listing and reading are split over tasks, and samples are never read.

    spark.dataSource.register(AudioHeaders)
    spark.read.format("audio_headers").load(root)

Planning lists folders only, level by level, until there are enough of them for the tasks;
each task lists the files below its folder and reads byte ranges of them: RIFF chunk
headers and the fmt chunk of a WAV file, the STREAMINFO block of a FLAC file. What is
wrong with a file is a row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, rel array<string>, length long, format string, rate int, channels int, bits int, frames long, duration double, bytes_read long, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
#: Folders that planning opens up, and rows of a batch.
FOLDERS, ROWS = 256, 1000
#: Chunks that may stand before the samples of a WAV file.
CHUNKS = 64


@dataclass
class Header:
    format: str
    rate: int
    channels: int
    bits: int
    frames: int

    @property
    def duration(self) -> float:
        return self.frames / self.rate


class Ranges:
    """A file read by ranges, and the bytes that these were."""

    def __init__(self, file: pa.NativeFile, length: int) -> None:
        self.file, self.length, self.count = file, length, 0

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        got = self.file.read(n)
        self.count += len(got)
        if len(got) < n:
            raise ValueError("the file ends within its header")
        return got


def wav_header(r: Ranges) -> Header:
    """RIFF and RF64. A data chunk without a size, or one beyond the end, is cut at the file's end."""
    big, fmt, at = None, None, 12
    for _ in range(CHUNKS):
        name, size = struct.unpack("<4sI", r.at(at, 8))
        if name == b"ds64":
            big = struct.unpack("<Q", r.at(at + 16, 8))[0]
        elif name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", r.at(at + 8, 16))
        elif name == b"data":
            if fmt is None:
                raise ValueError("no fmt chunk before the samples")
            _, channels, rate, _, block, bits = fmt
            if not (channels and rate and block):
                raise ValueError("a rate, channel or block size of zero")
            size = big if big is not None and size == 0xFFFFFFFF else size
            return Header("wav", rate, channels, bits, min(size, r.length - at - 8) // block)
        at += 8 + size + size % 2
    raise ValueError("no samples after the first chunks")


def flac_header(r: Ranges) -> Header:
    kind = r.at(4, 4)
    if kind[0] & 127:
        raise ValueError("STREAMINFO isn't the first block")
    packed = int.from_bytes(r.at(18, 8), "big")  # 20 bits of rate, 3 of channels, 5 of depth, 36 of samples
    rate, channels, bits, frames = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    if not rate or not frames:
        raise ValueError("STREAMINFO gives no rate or no number of samples")
    return Header("flac", rate, channels, bits, frames)


def header(r: Ranges) -> Header:
    start = r.at(0, 12)
    if start[:4] in (b"RIFF", b"RF64") and start[8:] == b"WAVE":
        return wav_header(r)
    if start[:4] == b"fLaC":
        return flac_header(r)
    raise ValueError("neither RIFF/WAVE nor FLAC")


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool

    def __post_init__(self) -> None:
        self.value = self.path


class HeaderReader(DataSourceReader):
    def __init__(self, root: str, suffixes: tuple[str, ...]) -> None:
        self.root, self.suffixes = root, suffixes

    def partitions(self) -> list[InputPartition]:
        """Folders, widest first: those opened up give their own files, those at the rim all that is below them."""
        system, base = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(base).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.root}")
        opened, rim = [], [base]
        while rim and len(opened) + len(rim) < FOLDERS:
            opened += rim
            rim = [x.path for folder in rim for x in system.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory]
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in rim]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(self.root)
        rows = []
        for info in system.get_file_info(fs.FileSelector(partition.path, recursive=partition.recursive)):
            if info.type != fs.FileType.File or not info.base_name.lower().endswith(self.suffixes):
                continue
            rows.append(self._row(system, base, info))
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _row(system: fs.FileSystem, base: str, info: fs.FileInfo) -> tuple:
        h, error, count = None, None, 0
        try:
            with system.open_input_file(info.path) as f:
                r = Ranges(f, info.size)
                try:
                    h = header(r)
                finally:
                    count = r.count
        except (ValueError, OSError, struct.error) as e:
            error = f"{type(e).__name__}: {e}"
        kind = h.format if h else info.base_name.rpartition(".")[2].lower()
        known = (h.rate, h.channels, h.bits, h.frames, round(h.duration, 4)) if h else (None,) * 5
        return (info.path, info.path[len(base.rstrip("/")) + 1 :].split("/"), info.size, kind, *known, count, error)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


class AudioHeaders(DataSource):
    """Options: path; suffixes, comma-separated (.wav,.flac)."""

    @classmethod
    def name(cls) -> str:
        return "audio_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> HeaderReader:
        root = self.options["path"]
        return HeaderReader(root if ":/" in root else f"file://{root}", tuple(self.options.get("suffixes", ".wav,.flac").lower().split(",")))


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, length, format, rate, channels, bits, frames, duration in seconds to 4 places, bytes_read, error) of the audio files below root."""
    spark.dataSource.register(AudioHeaders)
    return spark.read.format("audio_headers").load(root)
