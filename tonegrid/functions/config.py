"""Resolving stream parameters: pure column expressions over a parameter view, one narrow projection in the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME, MAX_BITS, QMF_BANDS = 1024, 6144, 64
DEFAULT_QUALITY, MAX_QUALITY, MIN_QUALITY, BANDWIDTH_CEILING = 100, 5000, 1, 18750

#: Lowest sample rate of each rate index but the last; fixed by the format.
RATE_THRESHOLDS = (92017, 75132, 55426, 46009, 37566, 27713, 23004, 18783, 13856, 11502, 9391)

#: Steps that the start band lies above its base, by rates up to 16, 22.05, 24, 32 and 64 kHz and above. Fixed values.
START_STEPS = (7, 13, 16, 16, 20, 24)
#: Rates a channel from which a mixed stream is of a tier, for plain and for SBR cores, and the highest frequency of mid/side
#: coding in long and short windows there (None: every band). Below all of them there is none. Fixed values.
MS_TIERS = ((40000, 40000, None, 0), (32000, 24000, None, 2000), (None, 20000, 1000, 1000))


def steps(value: Column, cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """A CASE over (condition, result) in order."""
    first, *rest = [(c, r if isinstance(r, Column) else F.lit(r)) for c, r in cases]
    return reduce(lambda case, x: case.when(*x), rest, F.when(*first)).otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative whole numbers."""
    return F.floor(a / b).cast("long")


def clamp(x: Column, low: object, high: object) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(as_column(high), x))


def max_bit_rate(rate: Column) -> Column:
    """Bits a second of one channel whose frames are all full."""
    return div(rate * MAX_BITS, FRAME)


def channel_config(channels: Column) -> Column:
    return F.when(channels.between(1, 6), channels).when(channels == 8, 7).otherwise(0)


def rate_index(rate: Column) -> Column:
    return steps(rate, [(rate >= low, i) for i, low in enumerate(RATE_THRESHOLDS)], len(RATE_THRESHOLDS))


def status(p: DataFrame) -> Column:
    """ok, invalid or unsupported, for each row of parameters."""
    bad = (
        ~p.mpeg_version.isin(2, 4) | ~p.joint_mode.isin("none", "ms", "is", "mixed") | (p.sample_rate <= 0) | (channel_config(p.channels) == 0)
        | (p.bit_rate > max_bit_rate(p.sample_rate)) | ((p.rate_control == "VBR") & (p.bit_rate > 0)) | (p.rate_control.isin("ABR", "CBR") & (p.bit_rate == 0))
        | ~p.rate_control.isin("AUTO", "VBR", "ABR", "CBR") | (p.max_bit_rate > 100_000_000) | ((p.max_bit_rate > 0) & (p.bit_rate > 0) & (p.max_bit_rate < p.bit_rate * p.channels))
    )
    return F.when(~p.mpeg_version.isin(2, 4), "invalid").when(p.object_type == "HE2", "unsupported").when(~p.object_type.isin("AUTO", "LC", "HE") | bad, "invalid").otherwise("ok")


def option_status(p: DataFrame) -> Column:
    """ok or invalid by the options beside rates and channels: block control, formats, channel map, reserved field. A
    null map is the channels' own order."""
    places = F.filter("channel_map", lambda x: x.isNull() | (x < 0) | (x >= p.channels))
    fits = F.col("channel_map").isNull() | ((F.size("channel_map") >= p.channels) & (F.size(F.slice(places, 1, 1)) == 0))
    known = p.short_control.isin("normal", "no_short", "no_long") & p.output_format.isin("raw", "framed") & p.input_format.isin("s16", "s24", "s32", "f32")
    return F.when(F.coalesce(known & fits & (p.reserved == 0), F.lit(False)), "ok").otherwise("invalid")


def band_layouts(n_lines: int = 1024, rates: int = 12) -> list[tuple[int, int, int, int]]:
    """A band layout for each rate index, as (rate_index, sfb, lo, hi), by a rule: widths are multiples of 4 that grow
    along the spectrum, and faster the higher the rate. A format's own layouts can take its place."""
    rows = []
    for i in range(rates):
        lo = sfb = 0
        while lo < n_lines:
            hi = min(n_lines, lo + 4 * (1 + lo // (32 + 4 * i)))
            rows.append((i, sfb, lo, hi))
            lo, sfb = hi, sfb + 1
    return rows


def with_layout(streams: DataFrame, index: Column, layouts: list[tuple[int, int, int, int]]) -> DataFrame:
    """Adds the bands of each stream's rate index, an array of (sfb, lo, hi): a broadcast of one row a rate."""
    dim = streams.sparkSession.createDataFrame(layouts, "__rate int, sfb int, lo int, hi int")
    dim = dim.groupBy("__rate").agg(F.array_sort(F.collect_list(F.struct("sfb", "lo", "hi"))).alias("layout"))
    return streams.join(F.broadcast(dim), index == F.col("__rate"), "left").drop("__rate")


def object_type(p: DataFrame) -> Column:
    """AUTO becomes HE where its rate, or without a rate its quality, is in HE's range; LC else."""
    ceiling = F.when(p.sample_rate >= 44100, 32000).when(p.sample_rate >= 32000, 12000 + div((p.sample_rate - 32000) * 20000, 12100)).otherwise(0)
    in_range = F.when(p.bit_rate > 0, p.bit_rate.between(8000, ceiling)).otherwise(p.quality <= 75)
    return F.when(p.object_type != "AUTO", p.object_type).when(in_range & (p.sample_rate >= 32000) & (p.mpeg_version != 2), "HE").otherwise("LC")


def bandwidth_curve(rate: Column) -> Column:
    return steps(rate, [(rate <= 8000, 9250), (rate <= 12000, 9250 + div((rate - 8000) * 5, 4)), (rate <= 32000, 14250), (rate <= 48000, 14250 + div((rate - 32000) * 9, 32))], BANDWIDTH_CEILING)


def quality_seed(rate: Column, channels: Column, core_rate: Column) -> Column:
    """First quality of a stream with a target rate, a whole number."""
    r = rate.cast("double")
    seed = F.when(r <= 16000, 10 + 22 * (r / 16000)).when(r <= 64000, 32 + 68 * ((r - 16000) / 48000)).otherwise(r / 640)
    seed = F.floor(F.when((channels == 1) & (rate >= 32000), seed * 2.5).otherwise(seed) * channels * (F.lit(44100.0) / core_rate))
    return F.when(seed > DEFAULT_QUALITY, (seed - DEFAULT_QUALITY) * 3 + DEFAULT_QUALITY).otherwise(seed).cast("long")


def resolved(p: DataFrame) -> DataFrame:
    """Valid rows of a parameter view with what follows from them: object type, core rate, rate control, bandwidth,
    quality, noise substitution level, treble slope, delay and the short-block rule for starved cores."""
    ok = p.where(status(p) == "ok").withColumn("kind", object_type(p))
    ok = ok.where((F.col("kind") != "HE") | (F.col("sample_rate") >= 32000)).withColumn("core_rate", F.when(F.col("kind") == "HE", div(F.col("sample_rate"), 2)).otherwise(F.col("sample_rate")))
    rate = F.least("bit_rate", max_bit_rate(F.col("core_rate")))
    ok = ok.withColumn("rate", rate)
    rate, he = F.col("rate"), F.col("kind") == "HE"
    derives = (rate > 0) & (F.col("bandwidth") == 0)
    wanted = F.when(F.col("bandwidth") > 0, F.col("bandwidth")).when(rate > 0, bandwidth_curve(rate)).otherwise(BANDWIDTH_CEILING)
    quality = F.when(F.col("quality") > 0, F.col("quality")).when(derives, quality_seed(rate, F.col("channels"), F.col("core_rate"))).otherwise(0)
    quality = clamp(F.when(quality == 0, DEFAULT_QUALITY).otherwise(quality), MIN_QUALITY, MAX_QUALITY)
    ok = ok.withColumns({
        "bandwidth": clamp(wanted, 100, div(F.col("core_rate"), 2)).cast("long"),
        "quality": quality.cast("long"),
        "control": F.when(F.col("rate_control") != "AUTO", F.col("rate_control")).when(rate > 0, "ABR").otherwise("VBR"),
    })
    noise = F.col("use_pns") & ((F.col("mpeg_version") != 2) | he)
    return ok.withColumns({
        "pns_level": F.when(~noise, 0).when((F.col("sample_rate") <= 16000) & (F.col("channels") == 1), 2).otherwise(4),
        "treble_slope": F.when(rate >= 56000, 3.0).otherwise(1.0),
        "delay": F.when(he, 2 * FRAME + 32).otherwise(FRAME),
        "only_short": he & F.when(rate > 0, rate < 14000).otherwise(F.col("quality") < 40),
    })


def elements(p: DataFrame) -> DataFrame:
    """stream_id, element_no, type, tag, ch0, ch1 and lfe: a single channel first unless there are two, then pairs,
    then what is left."""
    n = F.col("channels")
    lead = F.when((n != 2) & (n > 0), 1).otherwise(0)
    rows = p.withColumn("lead", lead).withColumn("pairs", div(n - F.col("lead"), 2)).withColumn("rest", (n - F.col("lead")) % 2)
    rows = rows.withColumn("total", F.col("lead") + F.col("pairs") + F.col("rest")).where("total > 0")
    rows = rows.withColumn("element_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1)))
    e = F.col("element_no")
    kind = F.when((F.col("lead") == 1) & (e == 0), "SCE").when(e < F.col("lead") + F.col("pairs"), "CPE").when(F.col("use_lfe"), "LFE").otherwise("SCE")
    rows = rows.withColumn("type", kind)
    ch0 = F.when(e < F.col("lead"), 0).otherwise(F.col("lead") + 2 * (e - F.col("lead")))
    # a last single channel is the second of its kind after a leading one
    tag = F.when(F.col("type") == "CPE", e - F.col("lead")).when((F.col("type") == "SCE") & (e > 0), F.col("lead")).otherwise(0)
    return rows.select("stream_id", "element_no", "type", tag.cast("long").alias("tag"), ch0.cast("long").alias("ch0"), F.when(F.col("type") == "CPE", ch0 + 1).cast("long").alias("ch1"), (F.col("type") == "LFE").alias("lfe"))


def band_at(offsets: list[int], hz: Column, width: int, rate: Column) -> Column:
    """Number of the first band at or after a frequency, in a grid of band starts for windows of ``width`` lines."""
    line = F.floor((hz * (2 * width) + rate - 1) / rate)
    return sum((F.when(F.lit(o) < line, 1).otherwise(0) for o in offsets), F.lit(0))


def stereo_policy(p: DataFrame, long_offsets: list[int], short_offsets: list[int]) -> DataFrame:
    """Adds, for long and short windows, the end of mid/side coding and the start of intensity coding, as bands."""
    rate, sbr, fs = F.col("rate"), F.col("kind") == "HE", F.col("core_rate")
    cap = F.least(F.lit(7000), div(fs * 7, 20))
    crossover = F.when(cap < 3500, cap).otherwise(clamp(F.floor(F.col("bandwidth") * 0.35), 3500, cap))

    def top(window: int) -> Column:
        """The highest frequency of mid/side coding; a stream without a rate is of the first tier."""
        reaches = lambda lc, he: (rate == 0) | F.coalesce(rate >= F.when(sbr, he).otherwise(lc), F.lit(False))
        mixed = steps(rate, [(reaches(lc, he), fs if hz[window] is None else F.lit(hz[window])) for lc, he, *hz in MS_TIERS], 0)
        return F.when(F.col("joint_mode") == "ms", fs).when(F.col("joint_mode") == "mixed", mixed).otherwise(0)

    ms_long, ms_short = band_at(long_offsets, top(0), 1024, fs), band_at(short_offsets, top(1), 128, fs)
    late = (ms_short == 0) & (F.col("joint_mode") == "mixed") & (rate >= 80000)
    return p.withColumns({
        "ms_end_long": ms_long, "ms_end_short": ms_short, "is_start_long": F.when(ms_long > 0, ms_long).otherwise(8),
        "is_start_short": F.when(late, band_at(short_offsets, crossover, 128, fs)).when(ms_short > 0, ms_short).otherwise(1),
    })


def sbr_bands(p: DataFrame) -> DataFrame:
    """Adds the SBR layout of HE rows by their rate: start and stop band, the stop index, envelopes, and the edges of
    the bands at high and low resolution. Arrays stay within the row; nothing is joined or shuffled."""
    fs, rate = F.col("sample_rate"), F.col("rate")
    edge = F.when(fs < 32000, 3000).when(fs < 64000, 4000).otherwise(5000)
    row = steps(fs, [(fs <= top, i) for i, top in enumerate((16000, 22050, 24000, 32000, 64000))], 5)
    offset = F.element_at(F.array(*[F.lit(n) for n in START_STEPS]), row + 1)
    kx = clamp(div(edge * 128 + div(fs, 2), fs) + offset, 1, 63)
    low = div(edge * 256 + div(fs, 2), fs)
    # thirteen geometric steps from the lowest stop band to 64, their widths sorted
    points = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.when(i == 0, F.col("stop_low")).otherwise(F.rint(F.col("stop_low") * F.pow(64.0 / F.col("stop_low"), i / 13.0))).cast("long"))
    widths = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.when(i == 13, F.lit(64).cast("long")).otherwise(F.get("points", i)) - F.get("points", i - 1)))
    stop = lambda i: F.aggregate(F.slice("widths", 1, i), F.col("stop_low"), lambda s, w: s + w)
    span = F.when(fs <= 32000, 48).when(fs <= 44100, 35).otherwise(32)
    stops = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.struct(i.alias("i"), stop(i).alias("k2")))
    fits = F.filter("stops", lambda s: s.k2 - F.col("kx") <= span)
    reach = F.filter(fits, lambda s: s.k2 * fs >= 20000 * 2 * QMF_BANDS)
    widest = F.element_at(fits, -1)
    out = p.withColumn("kx", kx).withColumn("stop_low", low).withColumn("points", points).withColumn("widths", widths).withColumn("stops", stops)
    chosen = F.when(F.size(reach) > 0, F.get(reach, F.lit(0))).when(F.size(fits) > 0, widest).otherwise(F.struct(F.lit(0).alias("i"), F.col("stop_low").alias("k2")))
    out = out.withColumn("chosen", chosen).withColumn("k2", F.col("chosen.k2")).withColumn("stop_index", F.col("chosen.i"))
    ratio = F.col("k2") / F.col("kx")
    per_octave = F.when(rate >= 12000, 8).otherwise(10)
    n = clamp(2 * F.floor(per_octave * F.log2(ratio) / 2 + 0.5), 1, 64).cast("int")
    out = out.withColumn("n_bands", n).withColumn("ratio", ratio)
    marks = F.transform(F.sequence(F.lit(0), F.col("n_bands")), lambda k: F.floor(F.col("kx") * F.pow(F.col("ratio"), k / F.col("n_bands")) + 0.5))
    out = out.withColumn("marks", marks)
    steps_sorted = F.array_sort(F.transform(F.sequence(F.lit(1), F.col("n_bands")), lambda k: F.get("marks", k) - F.get("marks", k - 1)))
    out = out.withColumn("steps", steps_sorted)
    edges = F.transform(F.sequence(F.lit(0), F.col("n_bands")), lambda k: F.aggregate(F.slice("steps", 1, k), F.col("kx").cast("long"), lambda s, w: s + w))
    out = out.withColumn("edges", edges)
    odd = F.col("n_bands") % 2
    halves = F.transform(F.sequence(F.lit(0), F.shiftright(F.col("n_bands") + 1, 1)), lambda b: F.get("edges", F.when(b == 0, 0).otherwise(2 * b - odd)))
    return out.withColumns({"edges_low": halves, "envelopes": F.when(rate >= 17000, 2).otherwise(1), "crossover": div(F.col("kx") * fs, 2 * QMF_BANDS)}).drop("points", "widths", "stops", "chosen", "ratio", "marks", "steps", "stop_low")
