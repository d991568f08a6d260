"""Live framing: Structured Streaming state holds what a stream has of its unfinished frame.

Samples may come in chunks of any size. A row with an end mark flushes the stream: its last frame is filled up with
zeros. Frames equal those of the batch operator, whatever the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_frames(samples: DataFrame, length: int) -> DataFrame:
    """stream_id, frame_no and pcm of a streaming frame with (stream_id, sample_no, x, ended). Within a trigger a
    stream's rows are put in order; across triggers they come in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("sample_no", kind="stable")
        held = list(held) + rows.loc[~rows["ended"], "x"].tolist()
        if rows["ended"].any() and held:
            held += [0.0] * (-len(held) % length)
        whole = len(held) // length
        frames = [held[k * length : (k + 1) * length] for k in range(whole)]
        state.update((number + whole, held[whole * length :]))
        yield pd.DataFrame({"stream_id": [key[0]] * whole, "frame_no": range(number, number + whole), "pcm": frames})

    return samples.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, frame_no long, pcm array<double>", "number long, held array<double>", "append", GroupStateTimeout.NoTimeout)
