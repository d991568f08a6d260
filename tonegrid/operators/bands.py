"""Spectral bands: energies, masking targets, scalefactors, quantization and stereo decisions.

A spectrum stays an array in its row, and bands are slices of it, so nothing here shuffles: whole-stage code over one
scan. Band layouts are small literal lists of starts with the end of the last band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands of a spectrum of 64 lines: widths 4, 4, 4, 4, 8, 8, 8, 12, 12.
EDGES_64 = (0, 4, 8, 12, 16, 24, 32, 40, 52, 64)
ROUND_UP, LARGEST = 0.4054, 8191
#: Scalefactor steps per factor of ten in amplitude, and half of it for energies.
STEP, HALF_STEP = 13.2877, 6.6439
SF_OFFSET, SF_MIN, SF_MAX_DELTA, SF_MAX = 100, 10, 60, 255


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squares(spec: str, lo: Column, width: Column) -> Column:
    return F.transform(F.slice(spec, lo + 1, width), lambda x: x * x)


def band_list(edges: Sequence[int]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("sfb"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def long_bands(spectra: DataFrame, edges: Sequence[int] = EDGES_64, spec: str = "spec") -> DataFrame:
    """Adds bands: for each band its number, lines, energy and largest squared line, in one window."""
    one = lambda b: F.struct(b.sfb.alias("sfb"), b.lo.alias("lo"), b.hi.alias("hi"), total(squares(spec, b.lo, b.hi - b.lo)).alias("energy"), F.array_max(squares(spec, b.lo, b.hi - b.lo)).alias("peak"))
    return spectra.withColumn("bands", F.transform(band_list(edges), one))


def short_bands(spectra: DataFrame, edges: Sequence[int], windows: int, spec: str = "spec") -> DataFrame:
    """Adds bands of a group of short windows: energies sum over the windows, peaks are the mean of the windows'."""
    length = edges[-1]
    each = lambda b, f: F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda w: f(squares(spec, w * length + b.lo, b.hi - b.lo)))
    one = lambda b: F.struct(b.sfb.alias("sfb"), b.lo.alias("lo"), b.hi.alias("hi"), total(each(b, total)).alias("energy"), (total(each(b, F.array_max)) / windows).alias("peak"))
    return spectra.withColumn("bands", F.transform(band_list(edges), one))


def masking_targets(banded: DataFrame, quality: Column, slope: float = 1.0, windows: int = 1, lines: int = 64) -> DataFrame:
    """Adds target to each of bands: allowed distortion from a band's energy and peak against the frame's mean, with
    floors, a roll-off to the treble and a slope for quiet bands. A silent group has targets of 0."""
    whole = F.col("whole")

    def one(b: Column) -> Column:
        ref = whole / lines * (b.hi - b.lo)
        mean, peak = F.greatest(b.energy, ref * 0.001) / ref, F.greatest(b.peak, ref * 0.005 / windows) / (ref / windows)
        t = (0.2 * F.pow(mean, 0.4) + 0.36 * F.pow(peak, 0.4)) * 10 / (1 + (b.lo + b.hi) * slope / lines)
        quiet = F.when(b.energy < 0.0003 * ref, F.sqrt(F.pow(b.energy / (0.0003 * ref), 0.4))).otherwise(1.0)
        target = F.when(whole < 0.16 * windows * lines, 0.0).otherwise(t * quiet * quality / 100)
        return F.struct(b.sfb.alias("sfb"), b.lo.alias("lo"), b.hi.alias("hi"), b.energy.alias("energy"), b.peak.alias("peak"), target.alias("target"))

    return banded.withColumn("whole", total(F.transform("bands", lambda b: b.energy))).withColumn("bands", F.transform("bands", one)).drop("whole")


def decisions(targeted: DataFrame, pns_level: float, windows: int = 1) -> DataFrame:
    """Adds kind (zero, noise, coded), level of noise bands and the scalefactor wish of coded ones to each band."""

    def one(b: Column) -> Column:
        mean, width = b.energy / windows, b.hi - b.lo
        quiet = (F.sqrt(mean / width) < 0.4) | (b.target == 0)
        sfac = F.rint(STEP * F.log10(b.target) - HALF_STEP * F.log10(mean) + HALF_STEP * F.log10(width))
        kind = F.when(quiet, "zero").when(b.target < 0.1 * pns_level, "noise").when(SF_OFFSET - sfac < SF_MIN, "zero").otherwise("coded")
        return F.struct(b.sfb.alias("sfb"), b.lo.alias("lo"), b.hi.alias("hi"), b.energy.alias("energy"), b.peak.alias("peak"), kind.alias("kind"),
                        F.when(kind == "noise", F.rint(HALF_STEP * F.log10(mean))).cast("int").alias("level"), F.when(kind == "coded", sfac).cast("int").alias("sfac"))

    return targeted.withColumn("bands", F.transform("bands", one))


def smoothed(decided: DataFrame) -> DataFrame:
    """Pulls each coded band's scalefactor 0.6 of the way to the mean of its coded neighbours (long blocks); a coded
    band stays coded. The wishes are relative, so a neighbour's weigh the other way round."""

    def one(b: Column, i: Column) -> Column:
        beside = F.filter(F.array(F.get(F.col("bands"), i - 1).sfac, F.get(F.col("bands"), i + 1).sfac), lambda x: x.isNotNull())
        mean = F.aggregate(beside, F.lit(0.0), lambda s, x: s - x) / F.greatest(F.size(beside), F.lit(1))
        pulled = F.least(b.sfac + F.when(F.size(beside) > 0, F.rint(0.6 * (-b.sfac - mean))).otherwise(0), F.lit(SF_OFFSET - SF_MIN)).cast("int")
        return F.struct(b.sfb.alias("sfb"), b.lo.alias("lo"), b.hi.alias("hi"), b.energy.alias("energy"), b.peak.alias("peak"), b.kind.alias("kind"), F.when(b.kind == "coded", pulled).alias("sfac"))

    return decided.withColumn("bands", F.transform("bands", one))


def gain(sfac: Column) -> Column:
    return F.pow(F.lit(2.0), sfac / 4)


def clamped(sfac: Column, peak: Column) -> Column:
    """The largest scalefactor up to sfac that keeps a band's peak, an amplitude, from growing past LARGEST."""
    most = F.pow(F.lit(LARGEST + 1 - ROUND_UP), 4 / 3)
    return F.when((peak > 0) & (gain(sfac) * peak > most), F.floor(4 * F.log2(most / peak)).cast("int")).otherwise(sfac)


def resolved_chain(smooth: DataFrame) -> DataFrame:
    """Adds chain: along the coded bands, the scalefactor sent (offset less sfac), at most SF_MAX_DELTA from the one
    before and within 0 and SF_MAX. Each depends on the one before through the clamp, so this folds over a row."""
    acc = "struct<last: int, out: array<struct<sfb: int, sent: int, sfac: int>>>"

    def step(s: Column, b: Column) -> Column:
        first = SF_OFFSET - clamped(b.sfac, F.sqrt(b.peak))
        near = F.when(s.last.isNull(), first).otherwise(s.last + F.greatest(F.lit(-SF_MAX_DELTA), F.least(F.lit(SF_MAX_DELTA), first - s.last)))
        sent = F.greatest(F.lit(0), F.least(F.lit(SF_MAX), near)).cast("int")
        item = F.struct(b.sfb.alias("sfb"), sent.alias("sent"), (SF_OFFSET - sent).cast("int").alias("sfac"))
        return F.struct(sent.alias("last"), F.concat(s.out, F.array(item)).alias("out")).cast(acc)

    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<sfb: int, sent: int, sfac: int>>").alias("out")).cast(acc)
    return smooth.withColumn("chain", F.aggregate(F.filter("bands", lambda b: b.kind == "coded"), start, step, lambda s: s.out))


def quantized(x: Column, g: Column) -> Column:
    """sign(x) * floor((|x| g) ^ 0.75 + ROUND_UP)."""
    return (F.signum(x) * F.floor(F.pow(F.abs(x) * g, 0.75) + ROUND_UP)).cast("int")


def book_floor(most: Column) -> Column:
    """The lowest codebook that holds values up to ``most``."""
    return F.when(most == 0, 0).when(most <= 1, 1).when(most <= 2, 3).when(most <= 4, 5).when(most <= 7, 7).when(most <= 12, 9).otherwise(11)


def pair_bands(pairs: DataFrame, edges: Sequence[int] = EDGES_64) -> DataFrame:
    """Adds bands of a channel pair: energies of left and right and their correlation."""
    dot = lambda a, b, at: total(F.zip_with(F.slice(a, at.lo + 1, at.hi - at.lo), F.slice(b, at.lo + 1, at.hi - at.lo), lambda x, y: x * y))
    one = lambda b: F.struct(b.sfb.alias("sfb"), b.lo.alias("lo"), b.hi.alias("hi"), dot("left", "left", b).alias("el"), dot("right", "right", b).alias("er"), dot("left", "right", b).alias("elr"))
    return pairs.withColumn("bands", F.transform(band_list(edges), one))


def stereo_decision(b: Column, ms_end: int, is_start: int, quality: float, mode: str = "mixed") -> Column:
    """lr, ms, in_phase or anti_phase for a pair's band."""
    q = quality / 100
    limit = 1.0 if mode == "ms" else min(2**0.5, 1 + 0.18 / (q if mode == "mixed" else q * q))
    both = b.el + b.er
    es, ed = F.greatest(both + 2 * b.elr, F.lit(0.0)), F.greatest(both - 2 * b.elr, F.lit(0.0))
    th = F.pow(F.sqrt(b.el) + F.sqrt(b.er), 2.0) / (limit * limit)
    ms = (b.sfb < ms_end) & (es * ed < 4 * b.el * b.er)
    shared = (b.sfb >= is_start) & (b.el > 0) & (b.er > 0)
    return F.when(both <= 0, "lr").when(ms, "ms").when(shared & (es >= th), "in_phase").when(shared & (ed >= th), "anti_phase").otherwise("lr")


def intensity_position(b: Column) -> tuple[Column, Column]:
    """Scalefactor of the sum and pan of the right channel, in energy steps."""
    sf = F.rint(HALF_STEP * F.log10(b.el / (b.el + b.er)))
    return sf.cast("int"), (F.rint(HALF_STEP * F.log10(b.er / (b.el + b.er))) - sf).cast("int")


def intensity_spectra(pairs: DataFrame, first_band: int, edges: Sequence[int] = EDGES_64) -> DataFrame:
    """pairs (left, right and more) with the bands from ``first_band`` on carried by the left channel alone: the sum of
    both, or their difference where they are in opposite phase, scaled to the energy of both. There the right channel
    is silent; below, both stay. Bands are joined back into whole spectra in the row."""
    found = pair_bands(pairs, edges)
    cut = lambda c, b: F.slice(c, b.lo + 1, b.hi - b.lo)

    def mixed(b: Column) -> Column:
        sign = F.when(b.elr >= 0, 1.0).otherwise(-1.0)
        own = b.el + b.er + sign * 2 * b.elr
        scale = F.when(own > 0, F.sqrt((b.el + b.er) / own)).otherwise(0.0)
        return F.when(b.sfb < first_band, cut("left", b)).otherwise(F.zip_with(cut("left", b), cut("right", b), lambda x, y: (x + sign * y) * scale))

    silent = lambda b: F.when(b.sfb < first_band, cut("right", b)).otherwise(F.transform(cut("right", b), lambda _: F.lit(0.0)))
    return found.withColumns({"left": F.flatten(F.transform("bands", mixed)), "right": F.flatten(F.transform("bands", silent))}).drop("bands")


#: Steps that a difference of scalefactors has at most, and how far noise lies under the first gain; fixed by the format.
MOST_DELTA, NOISE_OFFSET = 60, 90


def sent_scalefactors(bands: Column) -> Column:
    """For bands (sfb, kind, value) in order, with kinds coded, intensity and noise: what is sent and the value it restores.
    Each kind follows the last band of its own: coded bands start from the first coded value, intensity from 0, noise from
    the first coded value less an offset. Differences are clamped, and what a clamp takes stays in the chain; the first
    noise band is sent whole. Bands of other kinds are left out."""
    acc = "struct<coded: int, intensity: int, noise: int, first: boolean, out: array<struct<sfb: int, kind: string, delta: int, restored: int>>>"
    gain = F.coalesce(F.get(F.filter(bands, lambda b: b.kind == "coded"), F.lit(0)).value, F.lit(0))
    start = F.struct(gain.alias("coded"), F.lit(0).alias("intensity"), (gain - NOISE_OFFSET).alias("noise"), F.lit(True).alias("first"), F.array().cast("array<struct<sfb: int, kind: string, delta: int, restored: int>>").alias("out")).cast(acc)

    def step(s: Column, b: Column) -> Column:
        last = F.when(b.kind == "coded", s.coded).when(b.kind == "intensity", s.intensity).otherwise(s.noise)
        whole = (b.kind == "noise") & s["first"]
        delta = F.when(whole, b.value - last).otherwise(F.greatest(F.lit(-MOST_DELTA), F.least(F.lit(MOST_DELTA), b.value - last)))
        of = lambda kind, was: F.when(b.kind == kind, last + delta).otherwise(was)
        sent = F.struct(b.sfb.alias("sfb"), b.kind.alias("kind"), delta.alias("delta"), (last + delta).alias("restored"))
        return F.struct(of("coded", s.coded).alias("coded"), of("intensity", s.intensity).alias("intensity"), of("noise", s.noise).alias("noise"), (s["first"] & (b.kind != "noise")).alias("first"), F.concat(s.out, F.array(sent)).alias("out")).cast(acc)

    return F.aggregate(F.filter(bands, lambda b: b.kind.isin("coded", "intensity", "noise")), start, step, lambda s: s.out)


def autocorrelation(spec: Column, lags: int) -> Column:
    """Sums of products at distances 0 to lags."""
    return F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda k: total(F.zip_with(F.slice(spec, 1, F.size(spec) - k), F.slice(spec, k + 1, F.size(spec) - k), lambda a, b: a * b)))


def flatness(values: Column) -> Column:
    """Geometric over arithmetic mean of positive values."""
    n = F.size(values)
    return F.exp(total(F.transform(values, lambda x: F.log(x))) / n) / (total(values) / n)


def fir(spec: Column, taps: Sequence[float]) -> Column:
    """y[k] = x[k] + sum of taps[i] * x[k - 1 - i], with zeros before the start."""
    at = lambda k: F.when(k >= 0, F.get(spec, k)).otherwise(0.0)
    return F.transform(spec, lambda x, k: x + sum((at(k - 1 - i) * t for i, t in enumerate(taps)), F.lit(0.0)))


def reflection_index(k: Column, bits: int = 4) -> Column:
    """Arcsine quantizer of a reflection coefficient in -1 to 1, rounded half away from zero."""
    half = 1 << (bits - 1)
    s = F.asin(k) / F.lit(3.141592653589793 / 2)
    q = F.when(k >= 0, F.floor(s * (half - 0.5) + 0.5)).otherwise(F.ceil(s * (half + 0.5) - 0.5))
    return F.greatest(F.lit(-half), F.least(F.lit(half - 1), q)).cast("int")


def reflection_value(index: Column, bits: int = 4) -> Column:
    half, quarter = 1 << (bits - 1), 3.141592653589793 / 2
    return F.sin(F.when(index >= 0, index * quarter / (half - 0.5)).otherwise(index * quarter / (half + 0.5)))


def measured(bands: DataFrame, cutoff: int, silence: float = 0.4) -> DataFrame:
    """Bands with the energy and peak they are coded against. bands: any columns and lo, hi, windows (in the band's
    group), energy, peak (the mean of the windows' largest), ms, el and er. A band that starts at ``cutoff`` or above
    has neither. One coded as middle and side has half the weaker channel's energy, and its peak in proportion, unless
    it is silent itself."""
    swapped = F.col("ms") & (F.col("el") > 0) & (F.col("energy") >= silence * silence * F.col("windows") * (F.col("hi") - F.col("lo")))
    half = F.least("el", "er") / 2
    peak = F.when(swapped & (F.col("energy") > 0), F.col("peak") * half / F.col("energy")).otherwise(F.col("peak"))
    above = F.col("lo") >= cutoff
    return bands.withColumns({"coded_energy": F.when(above, 0.0).when(swapped, half).otherwise(F.col("energy")), "coded_peak": F.when(above, 0.0).otherwise(peak)})
