"""Framing, sub-block energies and block decisions, as window functions and aggregations over sample views.

Every window is partitioned by stream: one shuffle on stream_id serves the chain. The running level of ordinary streams
is folded in spans of sub-blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

SUB_BLOCKS = 8
LONG, LONG_SHORT, SHORT, SHORT_LONG = 0, 1, 2, 3

#: Half-band filter for 2:1 decimation: the symmetric taps from the outside in, and the one in the middle. Fixed values.
HALF_BAND = (
    -2.39042884e-03, 2.03978735e-03, -2.88625768e-03, 3.94878764e-03, -5.26747336e-03, 6.89408424e-03, -8.89782634e-03, 1.13774798e-02,
    -1.44815390e-02, 1.84491642e-02, -2.36937924e-02, 3.10005784e-02, -4.20596122e-02, 6.12815300e-02, -1.04870415e-01, 3.18777389e-01,
)
HALF_BAND_CENTRE = 0.5015570876767614


def by_stream(order: str) -> Window:
    return Window.partitionBy("stream_id").orderBy(order)


def frames(samples: DataFrame, length: int, lead: int = 0) -> DataFrame:
    """stream_id, frame_no and pcm: consecutive frames of ``length`` samples after ``lead`` zeros, the last one
    filled up with zeros. Chunking and partitioning of the input don't matter: places come from sample numbers."""
    at = F.col("sample_no") + lead
    placed = samples.select("stream_id", F.floor(at / length).cast("long").alias("frame_no"), (at % length).cast("int").alias("pos"), "x")
    made = placed.groupBy("stream_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("got"))
    values = F.transform("got", lambda s: s.x)
    head = F.array_repeat(F.lit(0.0), F.get(F.col("got"), F.lit(0)).pos)
    pcm = F.concat(head, values, F.array_repeat(F.lit(0.0), length - F.size(values) - F.size(head)))
    return made.select("stream_id", "frame_no", pcm.alias("pcm"))


def over_spans(samples: DataFrame, work: Callable[[DataFrame], DataFrame], span: int, back: int, ahead: int, unit: int, order: str = "frame_no") -> DataFrame:
    """``work(samples)``, with long streams cut into spans of ``span`` samples that are streams of their own inside, so
    that a stream of any length spreads over tasks. A span also has ``back`` samples before it and ``ahead`` after it:
    as many as a result depends on. Of the result (stream_id, ``order`` and more), what starts in a span is kept, where
    a step of ``order`` is ``unit`` samples; numbers stay those of the whole stream. What ``work`` does only at a
    stream's start it also does at the start of the overlap, where nothing is kept."""
    first, last = F.greatest(F.lit(0), F.floor((F.col("sample_no") - ahead) / span)), F.floor((F.col("sample_no") + back) / span)
    cut = samples.withColumn("__span", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    made = work(cut.withColumn("stream_id", F.struct("stream_id", "__span")).drop("__span"))
    return made.where(F.floor(F.col(order) * unit / span) == F.col("stream_id").getField("__span")).withColumn("stream_id", F.col("stream_id").getField("stream_id"))


def neighbours(framed: DataFrame, length: int) -> DataFrame:
    """Adds the frame before and the two after each frame, zeros where there is none."""
    w, none = by_stream("frame_no"), F.array_repeat(F.lit(0.0), length)
    beside = lambda k: F.coalesce(F.lag("pcm", k).over(w) if k > 0 else F.lead("pcm", -k).over(w), none)
    return framed.withColumns({"past": beside(1), "ahead1": beside(-1), "ahead2": beside(-2)})


def emitted(samples: DataFrame, length: int) -> DataFrame:
    """stream_id, n_samples, and the frames that a low-complexity and a high-efficiency stream emit with flushing."""
    n = F.max("sample_no") + 1
    sized = samples.groupBy("stream_id").agg(n.alias("n_samples"))
    up = lambda x, by: F.floor((x + (by - 1)) / by).cast("long")
    return sized.withColumns({"frames_lc": up(F.col("n_samples"), length) + 1, "frames_he": up(F.col("n_samples") + 1, 2 * length) + 2})


def sub_energies(samples: DataFrame, length: int) -> DataFrame:
    """stream_id, sub_no and energy of the first difference over two hops; eight hops are a frame. Samples are
    summed once into hops, and an energy is two neighbouring hops."""
    hop = length // SUB_BLOCKS
    d = F.col("x") - F.lag("x", 1, 0.0).over(by_stream("sample_no"))
    hops = samples.withColumn("d", d).where(F.col("sample_no") >= (length - hop) // 2)
    hops = hops.groupBy("stream_id", F.floor((F.col("sample_no") - (length - hop) // 2) / hop).cast("long").alias("sub_no")).agg(F.sum(F.col("d") * F.col("d")).alias("e"))
    return hops.select("stream_id", "sub_no", (F.col("e") + F.lead("e", 1, 0.0).over(by_stream("sub_no"))).alias("energy"))


def attacks_he(energies: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Adds level (the energy before) and attack: a step out of [level / ratio, level * ratio]."""
    level = F.lag("energy", 1, 0.0).over(by_stream("sub_no"))
    return energies.withColumn("level", level).withColumn("attack", (F.col("energy") > F.col("level") * ratio) | (F.col("energy") * ratio < F.col("level")))


def attacks_lc(energies: DataFrame, ratio: float = 2.5, drop: float = 12.0, smooth: float = 0.3, span: int = 256) -> DataFrame:
    """Adds level and attack against a running level, ``smooth`` of each energy and the rest of the level before.

    The level is an affine recurrence, so it is folded within spans of consecutive sub-blocks, one row a span, and a
    span starts from the spans before it. Those count by powers of what a span leaves of a level; past a few spans that
    is less than the smallest number, so a window of so many spans is all there is, and no stream is folded whole. In
    particular silence after sound keeps asking for short blocks for as long as in one fold."""
    rest = 1 - smooth
    reach = 1 + ceil(log(5e-324) / (span * log(rest))) if rest > 0 else 1
    own = energies.groupBy("stream_id", F.floor(F.col("sub_no") / span).cast("long").alias("span_no")).agg(F.array_sort(F.collect_list(F.struct("sub_no", "energy"))).alias("rows"))
    own = own.withColumn("left", F.aggregate("rows", F.lit(0.0), lambda level, r: r.energy * smooth + level * rest))
    w = by_stream("span_no")
    before = sum((F.coalesce(F.lag("left", k).over(w), F.lit(0.0)) * rest ** (span * (k - 1)) for k in range(1, reach + 1)), F.lit(0.0))
    acc = "struct<level: double, out: array<double>>"
    start = F.struct(F.col("before").alias("level"), F.array().cast("array<double>").alias("out")).cast(acc)
    step = lambda s, r: F.struct((r.energy * smooth + s.level * rest).alias("level"), F.concat(s.out, F.array(s.level)).alias("out")).cast(acc)
    levels = own.withColumn("before", before).withColumn("levels", F.aggregate("rows", start, step, lambda s: s.out))
    each = levels.select("stream_id", F.explode(F.arrays_zip("rows", "levels")).alias("z")).select("stream_id", "z.rows.sub_no", "z.rows.energy", F.col("z.levels").alias("level"))
    return each.withColumn("attack", (F.col("energy") > F.col("level") * ratio) | (F.col("energy") * drop < F.col("level")))


def wishes(attacked: DataFrame) -> DataFrame:
    """stream_id, frame_no, wish: whether a sub-block near the frame attacks. The newest sub-blocks at frame t are
    8t to 8t + 7, and those from 8t - 9 to 8t + 1 count."""
    per = attacked.groupBy("stream_id", F.floor(F.col("sub_no") / SUB_BLOCKS).cast("long").alias("frame_no")).agg(
        F.max("attack").alias("some"), F.max(F.col("attack") & (F.col("sub_no") % SUB_BLOCKS == SUB_BLOCKS - 1)).alias("last"), F.max(F.col("attack") & (F.col("sub_no") % SUB_BLOCKS < 2)).alias("first")
    )
    w = by_stream("frame_no")
    return per.select("stream_id", "frame_no", (F.col("first") | F.lag("some", 1, False).over(w) | F.lag("last", 2, False).over(w)).alias("wish"))


def block_types(wished: DataFrame, first_frame: int = 0) -> DataFrame:
    """Adds block_type. The machine has a closed form: with w = wish now or one frame before, and s = the same one
    frame before (true for the first coded frame), the two flags name the type; the first frame is short."""
    w = by_stream("frame_no")
    now = wished.withColumn("w", F.col("wish") | F.lag("wish", 1, False).over(w))
    s = F.when(F.col("frame_no") <= first_frame + 1, True).otherwise(F.lag("w", 1, False).over(w))
    kind = F.when(F.col("frame_no") == first_frame, SHORT).when(F.col("w") & s, SHORT).when(F.col("w"), LONG_SHORT).when(s, SHORT_LONG).otherwise(LONG)
    return now.withColumn("block_type", kind).drop("w")


def forced_types(kind: Column, lfe: Column, control: Column) -> Column:
    """Block type under the controls: low-frequency channels and no_short stay long, no_long is short."""
    return F.when(lfe | (control == "no_short"), LONG).when(control == "no_long", SHORT).otherwise(kind)


def attack_strength(energies: DataFrame) -> DataFrame:
    """stream_id, frame_no, strength: the largest |e - p| / min(e, p) between neighbouring sub-blocks of a frame.
    Null stands for an infinite one; 0 where nothing can be compared."""
    frame = F.floor(F.col("sub_no") / SUB_BLOCKS).cast("long")
    p = F.lag("energy").over(Window.partitionBy("stream_id", frame).orderBy("sub_no"))
    least = F.least("energy", "p")
    jumps = energies.withColumn("frame_no", frame).withColumn("p", p)
    jumps = jumps.withColumn("endless", F.coalesce((least == 0) & (F.col("energy") != F.col("p")), F.lit(False))).withColumn("jump", F.when(least > 0, F.abs(F.col("energy") - F.col("p")) / least))
    return jumps.groupBy("stream_id", "frame_no").agg(F.when(F.max("endless"), None).otherwise(F.coalesce(F.max("jump"), F.lit(0.0))).alias("strength"))


def delayed(payloads: DataFrame, column: str, frames_late: int, silence: Column) -> DataFrame:
    """Adds ``delayed``: the payload of some frames before, silence where there is none."""
    return payloads.withColumn("delayed", F.coalesce(F.lag(column, frames_late).over(by_stream("frame_no")), silence))


def decimate(samples: DataFrame) -> DataFrame:
    """stream_id, sample_no and x at half the rate, through the half-band filter: lags of one window, no join."""
    w = by_stream("sample_no")
    x = lambda k: F.lag("x", k, 0.0).over(w)
    total = x(31) * HALF_BAND_CENTRE
    for j, tap in enumerate(HALF_BAND):
        total = total + (x(62 - 2 * j) + x(2 * j)) * tap
    return samples.withColumn("y", total).where("sample_no % 2 = 0").select("stream_id", F.expr("sample_no div 2").alias("sample_no"), F.col("y").alias("x"))


def rounded_durations(positions: DataFrame, divisor: int) -> DataFrame:
    """Adds duration: differences of the rounded running positions, so that rounding never adds up."""
    at = F.floor((F.col("position") + divisor // 2) / divisor).cast("long")
    return positions.withColumn("rounded", at).withColumn("duration", F.col("rounded") - F.lag("rounded", 1, 0).over(by_stream("frame_no"))).drop("rounded")


def runs(rows: DataFrame, value: str, order: str = "frame_no") -> DataFrame:
    """stream_id, run_no, value and n: runs of equal values, by flagging changes and summing the flags."""
    w = by_stream(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("change", change).withColumn("run_no", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("stream_id", "run_no").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def peak_rate(sizes: DataFrame, sample_rate: int, frame_samples: int) -> DataFrame:
    """stream_id and the largest bit rate over whole windows of at least a second of equal frames: the windows
    tumble, so this is one aggregation."""
    each = -(-sample_rate // frame_samples)
    windows = sizes.groupBy("stream_id", F.floor(F.col("frame_no") / each).cast("long").alias("window_no")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("n") == each, F.floor(F.col("bytes") * 8 * sample_rate / (each * frame_samples)).cast("long"))
    return windows.groupBy("stream_id").agg(F.coalesce(F.max(rate), F.lit(0)).alias("peak_rate"))


def kept_peak_rate(sizes: DataFrame, sample_rate: int) -> DataFrame:
    """stream_id and the largest bit rate over windows of frames of any durations. sizes: stream_id, frame_no, size and
    duration. Frames shorter than the longest before them are left out; a window takes frames until it lasts a second
    and the next one starts anew.

    Where a window that starts at a frame ends is a look ahead in the running durations, for every frame at once. Which
    frames start windows follows by pointer doubling: from the first frame on, so many windows ahead are known after each
    round as before it, and the pointers jump twice as far. Rounds are the logarithm of a stream's windows, and frames are
    rows throughout."""
    w = by_stream("frame_no")
    before = lambda column: F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("longest", F.max("duration").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("duration = longest")
    kept = kept.select("stream_id", "frame_no", "size", "duration", (F.row_number().over(w) - 1).cast("long").alias("k"), before("duration").alias("at"), before("size").alias("bytes"))
    ends = kept.groupBy("stream_id").agg(F.count(F.lit(1)).alias("k"), F.sum("duration").alias("at"), F.sum("size").alias("bytes"))
    places = cut(kept.select("stream_id", "k", "at", "bytes", "duration").unionByName(ends.withColumn("duration", F.lit(0))))
    step = places.agg(F.max("duration")).first()[0] or 0  # the next place is at most so far beyond a second
    ahead = Window.partitionBy("stream_id").orderBy("at").rangeBetween(sample_rate, sample_rate + step)
    found = places.withColumn("next", F.min(F.struct("k", "at", "bytes")).over(ahead)).where("next is not null")
    rate = F.floor((F.col("next.bytes") - F.col("bytes")) * 8 * sample_rate / (F.col("next.at") - F.col("at")))
    windows = cut(found.select("stream_id", "k", F.col("next.k").alias("to"), rate.alias("rate")))
    starts, jumps = windows.where("k = 0").select("stream_id", "k"), windows.select("stream_id", "k", "to")
    while not jumps.isEmpty():
        starts = cut(starts.union(starts.join(jumps, ["stream_id", "k"]).select("stream_id", F.col("to").alias("k"))))
        jumps = cut(jumps.join(jumps.select("stream_id", F.col("k").alias("to"), F.col("to").alias("beyond")), ["stream_id", "to"]).select("stream_id", "k", F.col("beyond").alias("to")))
    best = windows.join(starts, ["stream_id", "k"]).groupBy("stream_id").agg(F.max("rate").alias("rate"))
    return ends.select("stream_id").join(best, "stream_id", "left").select("stream_id", F.coalesce("rate", F.lit(0)).alias("peak_rate"))


def common_windows(frames: DataFrame) -> DataFrame:
    """Frames of channels 2i and 2i + 1 as pairs: pair_no, frame_no, and common, whether they may be coded together, as
    their block types and numbers of window groups agree. frames: stream_id, frame_no, block_type, n_groups."""
    sides = frames.withColumn("pair_no", F.floor(F.col("stream_id") / 2).cast("long"))
    left = sides.where("stream_id % 2 = 0").select("pair_no", "frame_no", "block_type", "n_groups")
    right = sides.where("stream_id % 2 = 1").select("pair_no", "frame_no", F.col("block_type").alias("other_type"), F.col("n_groups").alias("other_groups"))
    both = left.join(right, ["pair_no", "frame_no"])
    return both.select("pair_no", "frame_no", ((F.col("block_type") == F.col("other_type")) & (F.col("n_groups") == F.col("other_groups"))).alias("common"))


def group_windows(bands: DataFrame, first_band: int, ratio: float = 3.0) -> DataFrame:
    """Lengths of the groups of a frame's short windows. bands: any columns and ``energy``, an array of windows, each
    an array of band energies. A window starts a group when more than three quarters of the bands have left the
    range of the group so far by ``ratio``. The fold takes as many steps as there are windows."""
    acc = "struct<lo: array<double>, hi: array<double>, n: int, lens: array<int>>"

    def step(s: Column, e: Column) -> Column:
        e = F.slice(e, first_band + 1, F.size(e))
        lo, hi = F.zip_with(s.lo, e, lambda a, b: F.least(a, b)), F.zip_with(s.hi, e, lambda a, b: F.greatest(a, b))
        votes = F.aggregate(F.zip_with(lo, hi, lambda a, b: F.when(b > a * ratio, 1).otherwise(0)), F.lit(0), lambda t, v: t + v)
        split = votes > F.floor(F.size(e) * 3 / 4)
        new = F.struct(e.alias("lo"), e.alias("hi"), F.lit(1).alias("n"), s.lens.alias("lens"))
        begun = F.struct(e.alias("lo"), e.alias("hi"), F.lit(1).alias("n"), F.concat(s.lens, F.array(s.n)).alias("lens"))
        same = F.struct(lo.alias("lo"), hi.alias("hi"), (s.n + 1).alias("n"), s.lens.alias("lens"))
        return F.when(s.n == 0, new).when(split, begun).otherwise(same).cast(acc)

    start = F.struct(F.array().cast("array<double>").alias("lo"), F.array().cast("array<double>").alias("hi"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("lens")).cast(acc)
    lens = F.aggregate("energy", start, step, lambda s: F.concat(s.lens, F.array(s.n)))
    return bands.withColumn("groups", lens)
