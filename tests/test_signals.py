"""Properties that SQL doesn't show: reconstruction, chunk and partition independence, silence, files, streams."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.functions import bits as X
from tonegrid.operators import frames as W
from tonegrid.operators import transforms as T
from tonegrid.operators.rate import rate_control
from tonegrid.operators.prediction import predicted, with_band_range
from tonegrid.operators.sections import LARGEST, cheapest_sections, fixed_length_costs
from tonegrid.sinks.containers import adts_streams, mp4_file, mp4_files
from tonegrid.sources import pcm
from tonegrid.sources.wav import Layout, file_frames, parse
from tonegrid.streaming.live import live_frames


def reflection(lags):
    """Coefficients and gains of rows of autocorrelations, row by row in plain loops."""
    ks, gains = [], []
    for row in lags:
        a, error, own = [1.0], row[0], []
        for i in range(1, len(row)):
            k = 0.0 if error == 0 else max(-0.999, min(0.999, -sum(a[j] * row[i - j] for j in range(i)) / error))
            a = [x + k * y for x, y in zip([*a, 0.0], [0.0, *a[::-1]])]
            own, error = [*own, k], error * (1 - k * k)
        ks.append(own)
        gains.append(row[0] / error if error > 0 else np.inf)
    return np.array(ks), np.array(gains)


def direct_form(ks):
    out = []
    for row in ks:
        a = [1.0]
        for k in row:
            a = [x + k * y for x, y in zip([*a, 0.0], [0.0, *a[::-1]])]
        out.append(a[1:])
    return np.array(out)


def samples(spark, values, parts=3, stream=1):
    return spark.createDataFrame([(stream, i, float(x)) for i, x in enumerate(values)], "stream_id long, sample_no long, x double").repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128])
def test_frames(spark, n):
    got = {r.frame_no: r.pcm for r in W.frames(samples(spark, range(1, n + 1)), 64, lead=1).collect()}
    whole = [0.0, *map(float, range(1, n + 1))]
    want = {k: whole[64 * k : 64 * (k + 1)] for k in range(-(-len(whole) // 64))} if n else {}
    assert got == {k: v + [0.0] * (64 - len(v)) for k, v in want.items()}


def test_frames_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(1).normal(size=1000)
    some, many = (sorted(map(tuple, W.sub_energies(samples(spark, x, p), 64).collect())) for p in (1, 9))
    assert [r[:2] for r in some] == [r[:2] for r in many] and np.allclose([r[2] for r in some], [r[2] for r in many])


def test_silence_after_sound_keeps_asking_for_short_blocks(spark):
    x = [0.0] * 64 + [1000.0 * (-1) ** i for i in range(64)] + [0.0] * 600
    got = {r.sub_no: r.attack for r in W.attacks_lc(W.sub_energies(samples(spark, x), 64)).collect()}
    assert not got[0] and all(got[k] for k in range(16, max(got) + 1))
    he = {r.sub_no: r.attack for r in W.attacks_he(W.sub_energies(samples(spark, x), 64)).collect()}
    assert not any(he[k] for k in range(20, max(he) + 1))


def test_block_types_follow_the_machine(spark):
    rows, want = [], {}
    for s, wish in enumerate(itertools.product([False, True], repeat=6)):
        kind, before = 2, wish[0]
        want[s, 0] = 2
        for t in range(1, 6):
            kind = (1 if kind in (0, 3) else 2) if wish[t] or before else (3 if kind in (1, 2) else 0)
            before, want[s, t] = wish[t], kind
        rows += [(s, t, w) for t, w in enumerate(wish)]
    got = W.block_types(spark.createDataFrame(rows, "stream_id long, frame_no long, wish boolean")).collect()
    assert {(r.stream_id, r.frame_no): r.block_type for r in got} == want


def test_transform_reconstructs():
    x = np.random.default_rng(2).normal(size=64 * 6)
    out = np.zeros_like(x)
    for k in range(5):
        out[64 * k : 64 * (k + 2)] += T.inverse(T.mdct(x[64 * k : 64 * (k + 2)][None]))[0]
    assert np.allclose(out[64:320], x[64:320])
    n = 64
    assert np.allclose(T.window(0, n)[:n] ** 2 + T.window(0, n)[n:] ** 2, 1)
    for kind in (1, 3):
        w = T.window(kind, n)
        assert w.min() >= 0 and w.max() <= 1 and len(w) == 2 * n
    assert T.mdct(x[None, :128], 2).shape == (1, 64)


def test_subbands_find_a_tone():
    t = np.arange(640)
    for band in range(8, 56, 6):
        e = T.subband_energies(np.cos(np.pi / 64 * (band + 0.5) * t)[None], 64)[0]
        assert e.argmax() == band


def test_short_blocks_have_no_inverse():
    with pytest.raises(ValueError, match="short blocks"):
        T.inverse(np.zeros((1, 64)), T.SHORT)


def test_interleaved_streams():
    """Four formats, mapped channels, bytes after the last whole block, and a format that isn't known."""
    x = np.array([[1, -2, 300], [4, 5, -32768], [7, 8, 9]])
    order = pcm.channel_map(3, 2, 1)
    for kind, raw, scale in (("s16", x.astype("<i2"), 1), ("s32", x.astype("<i4"), 256), ("f32", (x / 3).astype("<f4"), 3)):
        assert np.allclose(pcm.interleaved(raw.tobytes() + b"xy", kind, order), x.T[order] / scale)
    three = x.astype("<i4").ravel().view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    assert np.allclose(pcm.interleaved(three, "s24", order), x.T[order] / 256)
    assert pcm.interleaved(b"", "s16", order).shape == (3, 0)


def test_reservoir_stays_in_bounds(spark):
    rows = [(1, i, int(b)) for i, b in enumerate(np.random.default_rng(4).integers(0, 12000, 400))]
    got = rate_control(spark.createDataFrame(rows, "stream_id long, frame_no long, bits long"), 2, 64_000, 48_000, True).toPandas()
    budget = 2 * 64_000 * 1024 // 48_000
    assert got["fill"].between(0, 2 * 6144 - budget).all() and got["quality"].between(1, 5000).all() and (got["sent"].to_numpy() >= [r[2] for r in rows]).all()


def test_raw_samples():
    v = np.array([0, 1, -1, 32767, -32768])
    assert pcm.decode(v.astype("<i2").tobytes(), 2).tolist() == v.tolist() == pcm.decode(v.astype(">i2").tobytes(), 2, big=True).tolist()
    assert pcm.decode(bytes([0x56, 0x34, 0x92]), 3).tolist() == [(0x923456 - (1 << 24)) / 256] == pcm.decode(bytes([0x92, 0x34, 0x56]), 3, big=True).tolist()
    assert pcm.decode((v * 65536).astype("<i4").tobytes() + b"x", 4).tolist() == v.tolist()
    assert pcm.decode((v / 32768).astype("<f4").tobytes(), 4, floating=True).tolist() == v.tolist()
    assert pcm.decode(bytes([128, 0, 255]), 1).tolist() == [0, -32768, 127 * 256]
    assert pcm.channel_map(6, 3, 4) == [2, 0, 1, 4, 5, 3] and pcm.channel_map(2, 1, 2) == [0, 1] and pcm.channel_map(5) == [0, 1, 2, 3, 4]


def wav(data, channels=2, rate=8000, bits=16, tag=1, before=b"", extra=b""):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + extra
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_files(spark, tmp_path):
    x = np.arange(20, dtype="<i2")
    (tmp_path / "a.wav").write_bytes(wav(x.tobytes(), before=b"LIST\x03\x00\x00\x00abc\x00"))
    (tmp_path / "b.wav").write_bytes(wav(x.tobytes(), tag=0xFFFE, extra=struct.pack("<HHI", 22, 16, 3) + struct.pack("<H", 1) + bytes(14)))
    (tmp_path / "c.wav").write_bytes(b"RIFFxxxxWAVE")
    (tmp_path / "d.wav").write_bytes(wav(x.tobytes(), bits=64, tag=3))
    got = file_frames(spark, str(tmp_path), length=8).toPandas()
    for name in "ab":
        own = got[got["path"].str.endswith(f"{name}.wav")].sort_values(["channel", "frame_no"])
        assert own["pcm"].map(list).tolist() == [[0, 2, 4, 6, 8, 10, 12, 14], [16, 18] + [0] * 6, [1, 3, 5, 7, 9, 11, 13, 15], [17, 19] + [0] * 6] and set(own["n_samples"]) == {10}
    assert dict(got[got["status"] != "ok"][["path", "status"]].assign(path=lambda d: d["path"].str[-5:]).values) == {"c.wav": "no fmt chunk", "d.wav": "unsupported format"}
    with pytest.raises(ValueError):
        parse(b"")
    big = np.arange(6, dtype=">i2").tobytes()
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.raw").write_bytes(big)
    rows = file_frames(spark, str(tmp_path / "raw"), length=4, raw=Layout(44100, 2, 2, False, 0, 0)).collect()
    assert sorted((r.channel, r.pcm) for r in rows) == [(0, [0.0, 2.0, 4.0, 0.0]), (1, [1.0, 3.0, 5.0, 0.0])]


def test_names(spark):
    df = spark.createDataFrame([("a/b.c/x",), ("x.AAC",), ("-",), (None,), ("song.wav",)], "n string")
    got = [tuple(r) for r in df.select("n", X.is_mp4(df.n), X.output_name(df.n, X.is_mp4(df.n))).collect()]
    assert got == [("a/b.c/x", True, "a/b.c/x.m4a"), ("x.AAC", False, "x.aac"), ("-", False, "-.aac"), (None, True, None), ("song.wav", True, "song.m4a")]


def test_live_frames_equal_batch_frames(spark, tmp_path):
    x = [float(i * i % 97) for i in range(150)]
    schema = "stream_id long, sample_no long, x double, ended boolean"
    cuts = [0, 1, 40, 41, 130, 150]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows = [(7, i, x[i], False) for i in range(a, b)] + ([(7, 150, 0.0, True)] if b == 150 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    files = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = live_frames(files.drop("part"), 64).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.frame_no: r.pcm for r in spark.table("live").collect()}
    assert got == {r.frame_no: r.pcm for r in W.frames(samples(spark, x, stream=7), 64).collect()}


def test_prediction(spark):
    r = np.random.default_rng(6)
    x = np.array([np.convolve(row, [1, 0.9, 0.5])[:64] for row in r.normal(size=(20, 66))])
    lags = np.stack([(x[:, : 64 - i] * x[:, i:]).sum(1) for i in range(9)], 1)
    k, gain = reflection(lags)
    for row, own, g in zip(lags, k, gain):
        toeplitz = row[np.abs(np.subtract.outer(np.arange(8), np.arange(8)))]
        taps = np.linalg.solve(toeplitz, -row[1:])
        assert np.allclose(direct_form(own[None])[0], taps) and np.isclose(g, row[0] / (row[0] + taps @ row[1:]))
    assert np.isinf(reflection(np.zeros((1, 9)))[1][0])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "frame_no long, spec array<double>")
    got = predicted(df, ["frame_no"], least_gain=0.0).orderBy("frame_no").toPandas()
    assert np.allclose(got["gain"], gain) and got["kept_gain"].mean() > 0.7 * gain.mean()


def test_prediction_turns_away_what_it_does_not_help(spark):
    r = np.random.default_rng(8)
    tone = np.convolve(r.normal(size=66), [1, 0.9, 0.5])[:64]
    loud, edges = tone.copy(), (0, 16, 32, 48, 64)
    loud[:16] *= 1000
    quiet = np.r_[tone[:32], tone[32:] * 0.01]
    rows = {"silent": 0 * tone, "hushed": tone * 1e-6, "noise": np.sign(r.normal(size=64)) * 5, "quiet": quiet, "scaled": quiet * 50, "short": quiet, "rateless": quiet, "loud": loud}
    rate = {"short": 1, "rateless": 7}
    df = spark.createDataFrame([(i, rate.get(i, 0), x.tolist()) for i, x in rows.items()], "name string, rate int, spec array<double>")
    ranged = with_band_range(df, F.col("rate"), 4, [(0, 9), (3, 3)])
    got = {x.name: x for x in predicted(ranged, ["name"], edges=edges).collect()}
    assert set(got) == {"quiet", "scaled", "loud"}
    for name, x in got.items():
        own = rows[name].reshape(4, 16)
        rms = np.sqrt((own**2).mean(1, keepdims=True))
        w = (own / np.maximum(rms, rms.max() / 100)).ravel()
        lags = np.array([[w[: 64 - i] @ w[i:] for i in range(9)]])
        a = np.r_[1, direct_form(np.array([x.k]))[0]]
        assert np.isclose(x.gain, reflection(lags)[1][0]) and np.isclose(x.kept_gain, w @ w / (np.convolve(w, a)[:64] ** 2).sum())
        assert min(x.gain, x.kept_gain) >= 1.4 and x.length == 4 and 0 < x.filter_order <= 8 and not any(x.k[x.filter_order :])
        assert np.allclose(x.residual, np.convolve(rows[name], a)[:64])
    assert predicted(df.where("name in ('silent', 'hushed')"), ["name"], least_gain=0.0).count() == 0


def test_cheapest_sections_are_no_dearer_than_any_choice(spark):
    r = np.random.default_rng(7)
    rows = [(i, [[int(v) for v in r.integers(0, 2 ** r.integers(0, 5), 4)] for _ in range(4)]) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, q array<array<int>>")
    got = {x.i: x.bits for x in df.select("i", cheapest_sections(F.transform("q", lambda q: fixed_length_costs(q)), 9).alias("bits")).collect()}
    width = [(2 * top).bit_length() for top in LARGEST]
    for i, bands in rows:
        fits = [[b for b, top in enumerate(LARGEST) if max(q) <= top] for q in bands]
        assert got[i] == min(sum(4 * width[b] for b in books) + 9 * (1 + sum(a != b for a, b in zip(books, books[1:]))) for books in itertools.product(*fits))


def boxes(raw):
    at, found = 0, {}
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        assert 8 <= size <= len(raw) - at
        found.setdefault(kind, raw[at + 8 : at + size])
        at += size
    return found


def test_files_can_be_read_again(spark):
    rows = [(s, i, bytes([s, i] * (i + 1)), 1024 if i < 3 else 500) for s in (1, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "stream_id long, frame_no long, payload binary, duration int").repartition(3)
    for stream, content in adts_streams(df, F.lit(0), F.lit(4), F.lit(2)).collect():
        at, seen = 0, []
        while at < len(content):
            assert content[at] == 0xFF and content[at + 1] == 0xF1
            size = (content[at + 3] & 3) << 11 | content[at + 4] << 3 | content[at + 5] >> 5
            seen.append(bytes(content[at + 7 : at + size]))
            at += size
        assert seen == [p for s, _, p, _ in rows if s == stream]
    for stream, content in mp4_files(df, 44100, 2, b"\x12\x10").collect():
        own = [p for s, _, p, _ in rows if s == stream]
        top = boxes(bytes(content))
        assert list(top) == [b"ftyp", b"wide", b"mdat", b"moov"] and top[b"mdat"] == b"".join(own)
        table = boxes(boxes(boxes(boxes(boxes(top[b"moov"])[b"trak"])[b"mdia"])[b"minf"])[b"stbl"])
        assert struct.unpack(">IIIIII", table[b"stts"][:24]) == (0, 2, 3, 1024, 1, 500)
        assert struct.unpack(f">III{len(own)}I", table[b"stsz"]) == (0, 0, len(own), *map(len, own))
        offset = struct.unpack(">III", table[b"stco"])[2]
        assert bytes(content[offset : offset + 2]) == own[0]
    assert b"Song" in mp4_file([b"x"], [1024], 44100, 1, b"\x12\x08", tags={"nam": "Song", "mood": "fine"}, created=1)
