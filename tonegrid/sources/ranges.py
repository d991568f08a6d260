"""Sample files as Spark data sources: read in ranges of frames, and followed while they grow.

``spark.read.format("sample_frames")`` plans a partition for each range of frames: headers are read once, when partitions
are planned, and a task reads only its range's bytes, so one large file spreads over many tasks and none holds a file.
``spark.readStream.format("sample_stream")`` follows headerless files in a folder; offsets are bytes read of each file, so
a range is read again exactly as before when a query restarts. Files are reached through Arrow's file systems.

Options: ``path`` (a file or a folder), ``length`` (samples of a frame), ``frames`` (frames of a range), ``centre`` and ``lfe``
(1-based places of those channels), ``ignore_length`` (read to the file's end, whatever its header says of its length, as
for files that were never closed); for headerless files ``channels``, ``width`` (bytes of a sample), ``rate``, ``big``.
Files that can't be read have one row with their status and no frame. The last frame is filled up with zeros.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .pcm import channel_map, decode
from .wav import FIELDS, MOST_CHUNKS, Layout, format_of

NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
STREAM_FIELDS = "path string, channel int, sample_no long, x double, ended boolean"


def files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files at a path, hidden ones left out."""
    system, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path if scheme not in ("", "file://") else f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def opened(path: str) -> pa.NativeFile:
    system, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return system.open_input_file(at)


def located(source: pa.NativeFile, size: int) -> Layout:
    """A WAV file's layout, by reading the heads of its chunks only; ValueError says what is wrong with it."""

    def chunk(name: bytes, at: int) -> tuple[int, int]:
        for _ in range(MOST_CHUNKS + 1):
            head = source.read_at(8, at) if at + 8 <= size else b""
            if len(head) < 8:
                break
            n = int.from_bytes(head[4:], "little")
            if head[:4] == name:
                return at + 8, n
            at += 8 + n + n % 2
        raise ValueError(f"no {name.decode().strip()} chunk")

    head = source.read_at(12, 0) if size >= 12 else b""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, n = chunk(b"fmt ", 12)
    rate, channels, width, floating = format_of(source.read_at(min(n, 40), at))
    start, data = chunk(b"data", at + n + n % 2)
    return Layout(rate, channels, width, floating, start, min(data, size - start))


class Range(InputPartition):
    """Frames ``first`` to ``past`` of a file, or what is wrong with it."""

    def __init__(self, path: str, status: str, layout: Layout | None = None, first: int = 0, past: int = 0) -> None:
        self.path, self.status, self.layout, self.first, self.past = path, status, layout, first, past


def raw_layout(options: dict) -> Layout | None:
    if "channels" not in options:
        return None
    return Layout(int(options.get("rate", 44100)), int(options["channels"]), int(options.get("width", 2)), False, 0, 0)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.length, self.frames = dict(options), int(options.get("length", 1024)), int(options.get("frames", 4096))
        self.raw, self.big = raw_layout(self.options), str(options.get("big", "true")).lower() == "true"
        self.endless = str(options.get("ignore_length", "false")).lower() == "true"

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files(self.options["path"]):
            try:
                if self.raw:
                    layout = replace(self.raw, size=size)
                else:
                    with opened(path) as source:
                        layout = located(source, size)
                    if self.endless:
                        layout = replace(layout, size=size - layout.start)
            except ValueError as wrong:
                out.append(Range(path, str(wrong)))
                continue
            n = -(-(layout.size // (layout.channels * layout.width)) // self.length)
            out += [Range(path, "ok", layout, k, min(k + self.frames, n)) for k in range(0, n, self.frames)]
        return out or [Range("", "none")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.layout is None:
            if part.status != "none":
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part.path, part.status, *[None] * 6), TYPES)], names=NAMES)
            return
        layout, length = part.layout, self.length
        block = layout.channels * layout.width
        n_samples, order = layout.size // block, channel_map(layout.channels, int(self.options.get("centre", 0)), int(self.options.get("lfe", 0)))
        with opened(part.path) as source:
            for k in range(part.first, part.past, 64):  # a few frames at a time
                frames = min(64, part.past - k)
                have = min(n_samples - k * length, frames * length)
                raw = source.read_at(have * block, layout.start + k * length * block)
                values = decode(raw, layout.width, big=bool(self.raw) and self.big, floating=layout.floating).reshape(-1, layout.channels)[:, order]
                whole = np.zeros((frames * length, layout.channels))
                whole[: len(values)] = values
                for c in range(layout.channels):
                    same = [part.path, "ok", layout.sample_rate, layout.channels, n_samples, c]
                    pcm = pa.ListArray.from_arrays(pa.array(np.arange(frames + 1) * length, pa.int32()), pa.array(whole[:, c].copy()))
                    yield pa.RecordBatch.from_arrays([*[pa.array([v] * frames, t) for v, t in zip(same, TYPES)], pa.array(range(k, k + frames), pa.int64()), pcm], names=NAMES)


class SampleFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sample_frames"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: object) -> FrameReader:
        return FrameReader(self.options)


class Bytes(InputPartition):
    """Bytes ``first`` to ``past`` of a file, and whether the file ends there."""

    def __init__(self, path: str, first: int, past: int, ended: bool) -> None:
        self.path, self.first, self.past, self.ended = path, first, past, ended


class SampleReader(DataSourceStreamReader):
    """Whole blocks of samples of growing files. A file has ended once one of its name with ``.end`` lies beside it."""

    def __init__(self, options: dict) -> None:
        self.path, self.layout = options["path"], raw_layout({"channels": 1, **options})
        self.big, self.most = str(options.get("big", "true")).lower() == "true", int(options.get("bytes", 1 << 22))
        self.block = self.layout.channels * self.layout.width

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = dict(files(self.path))
        seen = {p: [n // self.block * self.block, f"{p}.end" in found] for p, n in found.items() if not p.endswith(".end")}
        return {"files": json.dumps(seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        before, out = json.loads(start["files"]), []
        for path, (past, ended) in json.loads(end["files"]).items():
            first, was = before.get(path, (0, False))
            step = self.most // self.block * self.block
            cuts = [*range(first, past, step), past]
            out += [Bytes(path, a, b, False) for a, b in zip(cuts, cuts[1:])]
            if ended and not was:
                out.append(Bytes(path, past, past, True))
        return out

    def read(self, part: Bytes) -> Iterator[pa.RecordBatch]:
        channels, names = self.layout.channels, [f.split(" ")[0] for f in STREAM_FIELDS.split(", ")]
        with opened(part.path) as source:
            raw = source.read_at(part.past - part.first, part.first)
        values = decode(raw, self.layout.width, big=self.big).reshape(-1, channels)
        n, at = len(values), part.first // self.block
        for c in range(channels):
            ends = [part.ended] * (n + part.ended)
            x = [None] * part.ended if part.ended else values[:, c]
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(ends), pa.string()), pa.array([c] * len(ends), pa.int32()), pa.array(range(at, at + len(ends)), pa.int64()), pa.array(x, pa.float64()), pa.array(ends, pa.bool_())], names=names)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: files stay where they are."""


class SampleStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sample_stream"

    def schema(self) -> str:
        return STREAM_FIELDS

    def streamReader(self, schema: object) -> SampleReader:
        return SampleReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session."""
    spark.dataSource.register(SampleFrames)
    spark.dataSource.register(SampleStream)
