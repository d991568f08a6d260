"""Files in ranges, growing files and published chunks: splits, restarts and tasks that run again."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tonegrid.sinks import published as P
from tonegrid.sources import ranges as R
from tonegrid.sources.wav import Layout, file_frames
from tonegrid.streaming.live import live_frames


def wav(x, channels=2, rate=8000, before=b""):
    data = x.astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def plain(df):
    return sorted((str(r.path).rpartition("/")[2], r.status, r.sample_rate, r.channels, r.n_samples, r.channel if r.channel is not None else -1, r.frame_no if r.frame_no is not None else -1, tuple(r.pcm or ())) for r in df.collect())


@pytest.mark.parametrize("frames", [1, 3, 1000])
def test_files_in_ranges(spark, tmp_path, frames):
    R.register(spark)
    x = np.random.default_rng(1).integers(-30000, 30000, 3011 * 2)
    (tmp_path / "a.wav").write_bytes(wav(x, before=b"LIST" + struct.pack("<I", 70_001) + bytes(70_002)))
    (tmp_path / "b.wav").write_bytes(wav(x[:10]))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVE")
    (tmp_path / "empty.wav").write_bytes(wav(x[:0]))
    got = spark.read.format("sample_frames").option("path", str(tmp_path)).option("length", 64).option("frames", frames).load()
    assert plain(got) == plain(file_frames(spark, str(tmp_path), length=64))
    parts = R.FrameReader({"path": str(tmp_path), "length": "64", "frames": str(frames)}).partitions()
    assert len(parts) == -(-48 // frames) + 2
    assert got.where("status = 'ok'").select(F.spark_partition_id()).distinct().count() >= min(4, 48 // frames)


def test_length_in_the_header_can_be_ignored(spark, tmp_path):
    R.register(spark)
    whole = bytearray(wav(np.arange(400)))
    at = whole.index(b"data") + 4
    whole[at : at + 4] = struct.pack("<I", 40)
    (tmp_path / "open.wav").write_bytes(bytes(whole))
    read = spark.read.format("sample_frames").options(path=str(tmp_path), length=10, frames=4)
    assert {r.n_samples for r in read.load().collect()} == {10}
    got = read.option("ignore_length", "true").load().where("channel = 1").orderBy("frame_no").collect()
    assert [x for r in got for x in r.pcm] == [float(x) for x in range(1, 400, 2)]


def test_headerless_files_in_ranges(spark, tmp_path):
    R.register(spark)
    (tmp_path / "x.pcm").write_bytes(np.arange(500, dtype=">i2").tobytes() + b"z")
    got = spark.read.format("sample_frames").options(path=str(tmp_path), length=32, frames=2, channels=1, width=2, rate=16000).load()
    assert plain(got) == plain(file_frames(spark, str(tmp_path), length=32, raw=Layout(16000, 1, 2, False, 0, 0)))
    none = tmp_path / "none"
    none.mkdir()
    assert spark.read.format("sample_frames").option("path", str(none)).load().count() == 0


def test_growing_files_restart_within_a_frame(spark, tmp_path):
    """Two runs of a query over files that grow in between, cut within frames: the frames are those of the whole files."""
    R.register(spark)
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    source.mkdir()
    x = {name: np.random.default_rng(n).integers(-9000, 9000, n).astype(">i2") for name, n in (("a.pcm", 1000), ("b.pcm", 333))}

    def run():
        live = spark.readStream.format("sample_stream").options(path=str(source), channels=1, width=2, bytes=256).load()
        named = live.select(F.when(F.col("path").endswith("a.pcm"), 1).otherwise(2).cast("long").alias("stream_id"), "sample_no", "x", "ended")
        live_frames(named, 64).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination(120)

    for name, v in x.items():
        (source / name).write_bytes(v.tobytes()[:301])  # within a sample
    run()
    for name, v in x.items():
        (source / name).write_bytes(v.tobytes())
        (source / f"{name}.end").write_bytes(b"")
    run()
    got = {(r.stream_id, r.frame_no): r.pcm for r in spark.read.parquet(str(out)).collect()}
    want = {}
    for s, v in ((1, x["a.pcm"]), (2, x["b.pcm"])):
        whole = np.concatenate([v.astype(float), np.zeros(-len(v) % 64)]).reshape(-1, 64)
        want |= {(s, k): row.tolist() for k, row in enumerate(whole)}
    assert got == want


def test_published_chunks(spark, tmp_path):
    """A task that writes and then fails, and its second try: each byte is there once; a failed job leaves nothing."""
    P.register(spark)
    path = str(tmp_path / "chunks")
    rows = [(s, k, 10 * k, bytes([s, k] * 5)) for s in range(3) for k in range(4)]
    df = spark.createDataFrame(rows, P.FIELDS).repartition(3)
    df.write.format("stream_chunks").mode("append").save(path)
    writer = P.ChunkWriter(path, False)
    lost = writer.write(iter(df.collect()))  # an attempt whose message never arrives
    again = writer.write(iter(df.where("stream_id = 1").collect()))
    writer.commit([again, None])
    failed = P.ChunkWriter(path, False)
    failed.write(iter(df.collect()))
    failed.abort([None])
    index = P.published(spark, path).collect()
    assert len(index) == len(rows) + 4 and not list((tmp_path / "chunks").glob(f"*{lost.name}*")) and not list((tmp_path / "chunks").glob(f"{failed.job}*"))
    found = sorted((r.stream_id, r.chunk_no, (tmp_path / "chunks" / r.file).read_bytes()[r.at : r.at + r.bytes]) for r in index)
    assert found == sorted([(s, k, c) for s, k, _, c in rows] + [(s, k, c) for s, k, _, c in rows if s == 1])
    df.limit(2).write.format("stream_chunks").mode("overwrite").save(path)
    assert P.published(spark, path).count() == 2
    assert issubclass(P.StreamChunks, DataSource) and P.published(spark, str(tmp_path)).count() == 0
