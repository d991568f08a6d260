"""Rate control: the bit reservoir, the balance and the quality update, as scans over each stream's frames.

All of it is column expressions: a stream's frames spread over spans, and what a frame needs of those before it comes from
the composed steps of the spans before its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import clamped

CHANNEL_BITS, MAX_QUALITY = 6144, 5000.0


def frame_budget(channels: int, bit_rate: int, sample_rate: int) -> int:
    return channels * bit_rate * 1024 // sample_rate


def rate_control(sizes: DataFrame, channels: int, bit_rate: int, sample_rate: int, constant: bool, start: float = 100.0, span: int = 64) -> DataFrame:
    """For given frame sizes (stream_id, frame_no, bits): what is sent with stuffing, the reservoir after the frame, the
    balance and the next frame's quality. ``constant`` keeps a reservoir of the decoder's buffer.

    Stuffing up to the reservoir's floor is the reservoir's upper limit seen from the other side, so reservoir and balance
    are running sums within limits; the quality is a running product of factors that follow from both."""
    budget = frame_budget(channels, bit_rate, sample_rate)
    cap = max(0, channels * CHANNEL_BITS - budget) if constant else 0
    bound, target = 4 * budget, int(0.99 * budget)
    rows = sizes.selectExpr("cast(stream_id as bigint) as stream_id", "cast(frame_no as bigint) as frame_no", "cast(bits as bigint) as bits")
    w = Window.partitionBy("stream_id").orderBy("frame_no")
    if constant:
        rows = clamped(rows, budget - F.col("bits"), 0, cap, cap // 2, "fill", span=span)
        floor = budget + F.lag("fill", 1, cap // 2).over(w) - max(cap, 16)
        rows = rows.withColumn("sent", F.greatest(F.col("bits"), floor))
    else:
        rows = rows.withColumns({"fill": F.lit(0).cast("bigint"), "sent": F.col("bits")})
    rows = clamped(rows, target - F.col("bits"), -bound, bound, 0, "balance", span=span)
    low, high = budget + F.col("fill") - cap, budget + F.col("fill")
    rows = rows.withColumn("aim", target + (F.col("balance") / 32).cast("bigint"))
    floored, capped = (F.col("aim") < low, F.col("bits") > high) if constant else (F.lit(False), F.lit(False))
    aim = F.least(F.greatest(F.col("aim"), low), high) if constant else F.col("aim")
    ratio = F.when(F.col("bits") > 0, aim.cast("double") / F.col("bits")).otherwise(1.0)
    share = F.lit(0.5) + F.lit(0.5) * F.col("balance") / bound
    eased = 1 + (ratio - 1) * F.when(share.between(0.25, 0.75), 0.6).otherwise(0.85)
    fix = F.when(floored, F.least(ratio, F.lit(1.5))).when(capped, F.greatest(ratio, F.lit(0.5))).otherwise(eased)
    stuffed = F.col("sent") > F.col("bits")
    rows = rows.withColumns({"fix": fix, "before": F.lag(F.when(stuffed, F.col("bits")).otherwise(0), 1, 0).over(w)})
    held = (F.col("fix") > 1) & stuffed & (F.col("before") > 0) & (F.col("bits") <= F.col("before") + F.expr("before div 50"))
    factor = F.when(held | (F.abs(F.col("fix") - 1) <= 0.005), 1.0).when(floored | capped, F.col("fix")).otherwise(F.least(F.lit(1.2), F.greatest(F.lit(0.8), F.col("fix"))))
    rows = clamped(rows.select("stream_id", "frame_no", "sent", "fill", "balance", factor.alias("factor")), F.col("factor"), 1.0, MAX_QUALITY, start, "quality", times=True, span=span)
    return rows.select("stream_id", "frame_no", "sent", "fill", "balance", "quality")
