"""Raw samples from bytes: 8, 16, 24 and 32 bit integers and 32 bit floats, on the scale of 16 bits; channel maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def decode(raw: bytes, width: int, big: bool = False, floating: bool = False) -> np.ndarray:
    """Samples of ``width`` bytes each; bytes that don't fill one are left out."""
    raw = raw[: len(raw) // width * width]
    order = ">" if big else "<"
    if floating:
        if width != 4:
            raise ValueError("floats have four bytes")
        return np.frombuffer(raw, f"{order}f4").astype(float) * 32768
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) * 256
    if width == 3:  # as the upper three bytes of four
        four = np.zeros((len(raw) // 3, 4), np.uint8)
        four[:, slice(0, 3) if big else slice(1, 4)] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return four.view(f"{order}i4").ravel() / 65536
    return np.frombuffer(raw, f"{order}i{width}").astype(float) / (1 if width == 2 else 65536)


def channel_map(channels: int, centre: int = 0, lfe: int = 0) -> list[int]:
    """Input channel for each output place: the centre (given by its place from 1) first, the low-frequency channel
    last, the others in order. Identity without either, or below three channels."""
    if channels < 3 or not (centre or lfe):
        return list(range(channels))
    first, last = (centre or 1) - 1, (lfe or channels) - 1
    between = [c for c in range(channels) if c not in (first, last)]
    ends = [c for c in (first, last) if c < channels]
    return ([first] if first < channels else []) + between[: channels - len(ends)] + ([last] if last < channels else [])


#: What a stream's caller may hand over: bytes of a sample, whether it is a float, and the divisor to the inner scale.
INPUT_FORMATS = {"s16": (2, False, 1), "s24": (3, False, 256), "s32": (4, False, 256), "f32": (4, True, 1)}


def interleaved(raw: bytes, kind: str, order: list[int]) -> np.ndarray:
    """The samples of an interleaved stream, a row for each output channel: the input channel that ``order`` names for it.
    Bytes after the last whole block of all channels are left out."""
    width, floating, divisor = INPUT_FORMATS[kind]
    blocks = np.frombuffer(raw, np.uint8)[: len(raw) // (width * len(order)) * width * len(order)].tobytes()
    values = decode(blocks, width, floating=floating) * (1 / 32768 if floating else 1)
    scale = {2: 1, 3: 256, 4: 65536}[width] / divisor if not floating else 1  # decode has integers on the scale of 16 bits
    return (values * scale).reshape(-1, len(order)).T[order]


def ingested(df: DataFrame, key: str, raw: str, kind: str, order: list[int]) -> DataFrame:
    """The key, channel, and samples of whole interleaved streams: ``raw`` holds bytes, ``kind`` names a column of formats.
    A null stream has no samples; a format that isn't known gives a null array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content, form = (batch.column(k).slice(i, 1) for k in range(3))
                known = form[0].as_py() in INPUT_FORMATS
                rows = interleaved(content[0].as_py() or b"", form[0].as_py(), order) if known else [None] * len(order)
                cols = [pa.concat_arrays([name] * len(order)), pa.array(range(len(order)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "channel", "samples"])

    of = df.schema[key].dataType.simpleString()
    return df.select(key, raw, kind).mapInArrow(run, f"{key} {of}, channel int, samples array<double>")


#: Bytes of a text that are decoded at once: whole samples of every width.
SPAN = 12 * 65536


def sums(df: DataFrame, key: str, text: str) -> DataFrame:
    """For whole texts as raw samples: bytes, and sums of what each integer format decodes to."""
    formats = (("u8", 1, False), ("s16", 2, False), ("s16_big", 2, True), ("s24", 3, False), ("s32", 4, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time as bytes, and of it a span: a worker holds the batch, one text and one span's samples
            raws = (x.as_py() or b"" for x in batch.column(1).cast(pa.binary()))
            rows = [(len(r), *[sum(float(decode(r[at : at + SPAN], w, big).sum()) for at in range(0, len(r), SPAN)) for _, w, big in formats]) for r in raws]
            counts, *cols = zip(*rows) if rows else [[]] * (len(formats) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *[pa.array(c, pa.float64()) for c in cols]], names=[key, "n_bytes", *[n for n, *_ in formats]])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, " + ", ".join(f"{n} double" for n, *_ in formats))
