"""WAV and headerless files as tables of samples.

Files are read whole by the binaryFile source, a row each, and parsed in Arrow batches; samples leave as frames, so no
row holds more than a frame of a channel. Broken files become rows with a status instead of failing the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pcm import channel_map, decode

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
MOST_CHUNKS = 10
FIELDS = "path string, status string, sample_rate int, channels int, n_samples long, channel int, frame_no long, pcm array<double>"


@dataclass(frozen=True)
class Layout:
    sample_rate: int
    channels: int
    width: int
    floating: bool
    start: int
    size: int


def chunk(raw: bytes, name: bytes, at: int) -> tuple[int, int]:
    """Start and size of the next chunk of that name; odd sizes are padded, and few chunks may come before it."""
    for _ in range(MOST_CHUNKS + 1):
        if at + 8 > len(raw):
            break
        size = struct.unpack_from("<I", raw, at + 4)[0]
        if raw[at : at + 4] == name:
            return at + 8, size
        at += 8 + size + size % 2
    raise ValueError(f"no {name.decode().strip()} chunk")


def format_of(fmt: bytes) -> tuple[int, int, int, bool]:
    """Sample rate, channels, bytes of a sample and whether samples are floats, from a fmt chunk."""
    if len(fmt) < 16:
        raise ValueError("short fmt chunk")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fmt)
    if tag == EXTENSIBLE and len(fmt) >= 40:
        tag = struct.unpack_from("<H", fmt, 24)[0]  # the format's number starts its identifier
    width = (bits + 7) // 8
    if tag not in (PCM, FLOAT) or not 1 <= channels <= 64 or not 1 <= width <= 4 or (tag == FLOAT and width != 4):
        raise ValueError("unsupported format")
    return rate, channels, width, tag == FLOAT


def parse(raw: bytes) -> Layout:
    """The layout of a WAV file; ValueError says what is wrong with it."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, size = chunk(raw, b"fmt ", 12)
    rate, channels, width, floating = format_of(raw[at : at + min(size, 40)])
    start, n = chunk(raw, b"data", at + size + size % 2)
    return Layout(rate, channels, width, floating, start, min(n, len(raw) - start))


def file_frames(spark: SparkSession, path: str, length: int = 1024, raw: Layout | None = None, centre: int = 0, lfe: int = 0) -> DataFrame:
    """A row for each frame of each channel of the files at a path, the last frame filled up with zeros; files that
    can't be read have one row with their status and no frame. ``raw`` gives the layout of headerless files."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            layout = raw or parse(content)
        except ValueError as wrong:
            yield name, str(wrong), None, None, None, None, None, None
            return
        n = len(content) - layout.start if raw else layout.size
        samples = decode(content[layout.start : layout.start + n], layout.width, big=bool(raw), floating=layout.floating)
        blocks = samples[: len(samples) // layout.channels * layout.channels].reshape(-1, layout.channels)[:, channel_map(layout.channels, centre, lfe)]
        padded = np.vstack([blocks, np.zeros((-len(blocks) % length, layout.channels))])
        for c in range(layout.channels):
            for k in range(len(padded) // length):
                yield name, "ok", layout.sample_rate, layout.channels, len(blocks), c, k, padded[k * length : (k + 1) * length, c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "status", "sample_rate", "channels", "n_samples", "channel", "frame_no", "pcm"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                for row in rows(name, content):
                    held.append(row)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)
