"""Windowed cosine transform and filter-bank energies: matrix products over Arrow batches.

A basis is a constant of the Python worker, and a batch of frames is one product; frames stay in their partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, LONG_SHORT, SHORT, SHORT_LONG = 0, 1, 2, 3
#: Values that go through a product at once. A product's temporary arrays are many times its input, so a worker's memory
#: follows this and not the rows of a batch.
PIECE = 1 << 15


@lru_cache
def sine(n: int) -> np.ndarray:
    """The rising half of a sine window."""
    return np.sin(np.pi / (2 * n) * (np.arange(n) + 0.5))


@lru_cache
def window(kind: int, n: int) -> np.ndarray:
    """Window of 2n samples for a block kind; a side that meets short blocks (n / 8) is flat but for a short slope."""
    short = n // 8
    flat = (n - short) // 2
    slope = np.concatenate([np.zeros(flat), sine(short), np.ones(flat)])
    rise = slope if kind == SHORT_LONG else sine(n)
    fall = slope if kind == LONG_SHORT else sine(n)
    return np.concatenate([rise, fall[::-1]])


@lru_cache
def cosines(n: int) -> np.ndarray:
    """Basis of the transform of 2n samples into n lines."""
    at = np.arange(2 * n)[:, None] + 0.5 + n / 2
    return 2 * np.cos(np.pi / n * at * (np.arange(n) + 0.5))


def mdct(blocks: np.ndarray, kind: int = LONG) -> np.ndarray:
    """Lines of blocks of 2n samples (rows). Short blocks: eight transforms of 2n / 8, from the middle of the block."""
    n = blocks.shape[1] // 2
    if kind != SHORT:
        return blocks * window(kind, n) @ cosines(n)
    short = n // 8
    first = (n - short) // 2
    slope = np.concatenate([sine(short), sine(short)[::-1]])
    parts = [blocks[:, first + w * short : first + (w + 2) * short] * slope @ cosines(short) for w in range(8)]
    return np.concatenate(parts, axis=1)


def inverse(lines: np.ndarray, kind: int = LONG) -> np.ndarray:
    """Windowed samples whose overlapping halves add up to the signal (for tests and decoders of own output)."""
    n = lines.shape[1]
    if kind == SHORT:
        raise ValueError("short blocks have no inverse here")
    return lines @ cosines(n).T / (2 * n) * window(kind, n)


@lru_cache
def prototype(bands: int) -> np.ndarray:
    """A low-pass prototype of ten taps a band, by rule: a sine cardinal under a Kaiser window, of unit sum."""
    k = np.arange(10 * bands) - (10 * bands - 1) / 2
    taps = np.sinc(k / (2 * bands)) * np.kaiser(10 * bands, 8.0)
    return taps / taps.sum()


def subband_energies(blocks: np.ndarray, bands: int) -> np.ndarray:
    """Energy of each band for blocks of ten times ``bands`` samples, the newest last."""
    folded = (blocks[:, ::-1] * prototype(bands)).reshape(len(blocks), 5, 2 * bands).sum(1)
    j, k = np.arange(2 * bands)[:, None], np.arange(bands)
    return np.abs(folded @ np.exp(-1j * np.pi * (2 * k + 1) * j / (2 * bands))) ** 2


def transformed(frames: DataFrame, column: str, keep: list[str], out: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The columns ``keep``, and ``out``: work's rows for the arrays of a column, all of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = max(1, PIECE * batch.num_rows // max(1, len(batch.column(len(keep)).flatten())))
            for at in range(0, batch.num_rows, each):
                piece = batch.slice(at, each)
                made = work(piece.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1))
                ends = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(keep))] + [lists], names=[*keep, out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keep).schema) + f", {out} array<double>"
    return frames.select(*keep, F.col(column).cast("array<double>")).mapInArrow(run, schema)
