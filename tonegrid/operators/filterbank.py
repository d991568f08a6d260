"""The high-efficiency front end across frames: the signal at half its rate, the energies of time slots, and the energies of a
filter bank's bands in each slot, in one pass.

The bank looks back over ten slots and the half-band filter over 62 samples, so a frame needs the end of the one before it.
Each sample goes to its frame and, if a later frame looks back to it, to that one's history too: frames with their
history are rows apart, in any order, and a stream of any length spreads over tasks. What lies before a stream is silence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import HALF_BAND, HALF_BAND_CENTRE
from .transforms import prototype, transformed

#: Taps of the bank's prototype, in slots, and samples that the half-band filter looks back.
TAPS, BACK = 10, 62


def history(bands: int) -> int:
    """Samples before a frame that it looks back to."""
    return max((TAPS - 1) * bands, BACK)


def with_history(samples: DataFrame, length: int, back: int) -> DataFrame:
    """stream_id, frame_no and pcm: ``back`` samples before the frame and the frame's ``length``, filled up with zeros."""
    at = F.col("sample_no")
    # a sample is also in the history of the frames that begin within ``back`` samples after it
    last = F.least(F.floor((at + back) / length), F.col("__end"))
    ends = samples.groupBy("stream_id").agg(F.floor(F.max("sample_no") / length).alias("__end"))
    spread = samples.join(ends, "stream_id").withColumn("frame_no", F.explode(F.sequence(F.floor(at / length), last)))
    placed = spread.select("stream_id", "frame_no", (at - F.col("frame_no") * length + back).cast("int").alias("pos"), "x")
    made = placed.groupBy("stream_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("got"))
    head = F.array_repeat(F.lit(0.0), F.get("got", F.lit(0)).pos)
    values = F.transform("got", lambda s: s.x)
    return made.select("stream_id", F.col("frame_no").cast("long").alias("frame_no"), F.concat(head, values, F.array_repeat(F.lit(0.0), back + length - F.size(values) - F.size(head))).alias("pcm"))


def bank(bands: int, slots: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of frames with their history (rows): the band energies of each slot, then the slots' own energies, then half the
    rate's samples."""
    back, length = history(bands), bands * slots
    taps = np.zeros(BACK + 1)
    taps[: 2 * len(HALF_BAND) : 2], taps[BACK : BACK - 2 * len(HALF_BAND) : -2], taps[BACK // 2] = HALF_BAND, HALF_BAND, HALF_BAND_CENTRE
    j, k = np.arange(2 * bands)[:, None], np.arange(bands)
    turns = np.exp(-1j * np.pi * (2 * k + 1) * j / (2 * bands))

    def work(pcm: np.ndarray) -> np.ndarray:
        rows = len(pcm)
        # the last TAPS * bands samples up to each slot's end, the newest first
        seen = np.lib.stride_tricks.sliding_window_view(pcm[:, back - (TAPS - 1) * bands :], TAPS * bands, axis=1)[:, ::bands, ::-1]
        folded = (seen * prototype(bands)).reshape(rows, slots, TAPS // 2, 2 * bands).sum(2)
        energies = np.abs(folded @ turns) ** 2
        own = (pcm[:, back:].reshape(rows, slots, bands) ** 2).sum(2)
        half = np.lib.stride_tricks.sliding_window_view(pcm[:, back - BACK :], BACK + 1, axis=1)[:, ::2] @ taps
        return np.concatenate([energies.reshape(rows, -1), own, half[:, : length // 2]], axis=1)

    return work


def analysed(samples: DataFrame, bands: int = 64, slots: int = 32) -> DataFrame:
    """stream_id, frame_no, bank (for each slot an array of band energies), slot_energy and half (the frame at half the
    rate). samples: stream_id, sample_no, x; a frame is bands * slots samples."""
    framed = with_history(samples, bands * slots, history(bands))
    made = transformed(framed, "pcm", ["stream_id", "frame_no"], "all", bank(bands, slots))
    energies = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.slice("all", s * bands + 1, bands))
    rest = slots * bands
    return made.select("stream_id", "frame_no", energies.alias("bank"), F.slice("all", rest + 1, slots).alias("slot_energy"), F.slice("all", rest + slots + 1, rest // 2).alias("half"))
