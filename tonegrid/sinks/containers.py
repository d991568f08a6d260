"""Coded frames as files: a stream with headers, or an MP4 file with its index.

Streams of any length are chunks with their byte offsets, which are prefix sums in two levels. For short streams there
are whole files too, a row each; there a stream's frames meet in one row, after all work on frames is done.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import adts_header

#: Seconds between 1904 and 1970, and the language code of an undefined language.
MP4_EPOCH, UNDEFINED = 2_082_844_800, 0x55C4


def adts_streams(frames: DataFrame, mpeg2: Column, rate_index: Column, channels: Column) -> DataFrame:
    """stream_id and content: each payload (stream_id, frame_no, payload) after its header, in order."""
    size = F.length("payload") + 7
    whole = F.concat(adts_header(mpeg2, rate_index, channels, size, F.lit(0x7FF)), F.hex("payload"))
    rows = frames.select("stream_id", F.struct("frame_no", whole.alias("hex")).alias("f"))
    joined = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return joined.select("stream_id", F.unhex(F.array_join(F.transform("f", lambda x: x.hex), "")).alias("content"))


def frame_offsets(frames: DataFrame, span: int = 1024) -> DataFrame:
    """Adds chunk_no and offset to frames (stream_id, frame_no, size): the bytes of all frames of the stream before. Sums
    are made within ``span`` frames, and over the totals of spans."""
    spanned = frames.withColumn("chunk_no", F.floor(F.col("frame_no") / span).cast("long"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = spanned.groupBy("stream_id", "chunk_no").agg(F.sum("size").alias("total"))
    starts = totals.select("stream_id", "chunk_no", F.coalesce(F.sum("total").over(before("stream_id").orderBy("chunk_no")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("size").over(before("stream_id", "chunk_no").orderBy("frame_no")), F.lit(0))
    return spanned.withColumn("inside", inside).join(starts, ["stream_id", "chunk_no"]).withColumn("offset", F.col("start") + F.col("inside")).drop("inside", "start")


def adts_chunks(frames: DataFrame, mpeg2: Column, rate_index: Column, channels: Column, span: int = 1024) -> DataFrame:
    """stream_id, chunk_no, offset and content: the headed frames of a stream in chunks of ``span`` frames, each with its
    place in the stream's bytes, so that any number of tasks can write one stream."""
    size = F.length("payload") + 7
    whole = F.concat(adts_header(mpeg2, rate_index, channels, size, F.lit(0x7FF)), F.hex("payload"))
    rows = frame_offsets(frames.withColumn("size", size.cast("long")), span)
    chunks = rows.groupBy("stream_id", "chunk_no").agg(F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("frame_no", whole.alias("hex")))).alias("f"))
    return chunks.select("stream_id", "chunk_no", "offset", F.unhex(F.array_join(F.transform("f", lambda x: x.hex), "")).alias("content"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def described(tag: int, body: bytes) -> bytes:
    n = len(body)
    return bytes([tag, n >> 21 & 127 | 128, n >> 14 & 127 | 128, n >> 7 & 127 | 128, n & 127]) + body


def text_tag(kind: bytes, value: str) -> bytes:
    return box(kind, box(b"data", struct.pack(">II", 1, 0), value.encode()))


def mp4_file(payloads: list[bytes], durations: list[int], rate: int, channels: int, config: bytes, tags: dict[str, str] | None = None, priming: int = 0, created: int = 0) -> bytes:
    """A whole file: type, media, then the index with sizes, run lengths of durations and tags."""
    head = box(b"ftyp", b"M4A ", struct.pack(">I", 0), b"M4A mp42isom") + box(b"wide")
    media = b"".join(payloads)
    large = len(media) + 8 >= 1 << 32
    head += struct.pack(">I4sQ", 1, b"mdat", len(media) + 16) if large else struct.pack(">I4s", len(media) + 8, b"mdat")
    offset, samples, seconds = len(head), sum(durations), max(1, sum(durations)) / rate
    bits = int(8 * len(media) / seconds) if payloads else 0
    when = created + MP4_EPOCH if created else 0
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs: list[list[int]] = []
    for d in durations:
        if runs and runs[-1][1] == d:
            runs[-1][0] += 1
        else:
            runs.append([1, d])
    decoder = struct.pack(">BB", 0x40, 0x15) + max(map(len, payloads), default=0).to_bytes(3, "big") + struct.pack(">II", bits, bits) + described(5, config)
    esds = full(b"esds", described(3, struct.pack(">HB", 0, 0) + described(4, decoder) + described(6, b"\x02")))
    entry = box(b"mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHI", channels, 16, 0), struct.pack(">I", (rate & 0xFFFF) << 16), esds)
    where = full(b"co64", struct.pack(">IQ", 1, offset)) if offset >= 1 << 32 else full(b"stco", struct.pack(">II", 1, offset))
    table = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">I", len(runs)), *[struct.pack(">II", *r) for r in runs]), full(b"stsc", struct.pack(">IIII", 1, 1, len(payloads), 1)),
        full(b"stsz", struct.pack(">II", 0, len(payloads)), *[struct.pack(">I", len(p)) for p in payloads]), where,
    )
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", when, when, rate, samples, UNDEFINED, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
    trak = box(
        b"trak", full(b"tkhd", struct.pack(">IIIIIII", when, when, 1, 0, samples, 0, 0), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7),
        box(b"edts", full(b"elst", struct.pack(">IIII", 1, max(0, samples - priming), priming, 0x10000))), mdia,
    )
    listed = [text_tag(b"\xa9" + k.encode("latin-1"), v) if len(k) == 3 else box(b"----", full(b"mean", b"tonegrid"), full(b"name", k.encode()), box(b"data", struct.pack(">II", 1, 0), v.encode())) for k, v in (tags or {}).items()]
    udta = box(b"udta", full(b"meta", full(b"hdlr", bytes(4), b"mdirappl", bytes(9)), box(b"ilst", *listed)))
    mvhd = full(b"mvhd", struct.pack(">IIIII", when, when, rate, samples, 0x10000), struct.pack(">HHII", 0x100, 0, 0, 0), matrix, bytes(24), struct.pack(">I", 2))
    return head + media + box(b"moov", mvhd, trak, udta)


def mp4_files(frames: DataFrame, rate: int, channels: int, config: bytes, priming: int = 1024) -> DataFrame:
    """stream_id and content: a file for each stream of payloads (stream_id, frame_no, payload, duration)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_no")
        content = mp4_file(rows["payload"].tolist(), rows["duration"].tolist(), rate, channels, config, priming=priming)
        return pd.DataFrame({"stream_id": [rows["stream_id"].iloc[0]], "content": [content]})

    return frames.select("stream_id", "frame_no", "payload", "duration").groupBy("stream_id").applyInPandas(one, "stream_id long, content binary")
