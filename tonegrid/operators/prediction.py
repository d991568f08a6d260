"""Prediction along a spectrum's lines, in column expressions: the recursions over the order are folds over arrays in a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import total

#: Bands that a predictor covers (first, and the one past the last) by rate index, in the format's own band layouts.
PREDICTED_BANDS = ((11, 31), (12, 31), (15, 34), (16, 40), (17, 42), (20, 51), (25, 46), (26, 46), (24, 42), (28, 42), (30, 42), (31, 39))
#: Energy and RMS under which a band is silent; flatness of bands' RMS over which a spectrum is noise; the share of the
#: loudest band's RMS that the others count with at least.
SILENT, NOISE, FLOOR = 1e-9, 0.85, 0.01


def with_band_range(spectra: DataFrame, rate_index: Column, n_bands: int, ranges: Sequence[tuple[int, int]] = PREDICTED_BANDS) -> DataFrame:
    """spectra with first_band and past_band by their rate index, within ``n_bands``; rows of other rates have nulls."""
    rows = [(i, min(lo, n_bands), min(hi, n_bands)) for i, (lo, hi) in enumerate(ranges)]
    bands = spectra.sparkSession.createDataFrame(rows, "__rate int, first_band int, past_band int")
    return spectra.join(F.broadcast(bands), rate_index == F.col("__rate"), "left").drop("__rate")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; inside lambdas an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squared(x: Column) -> Column:
    return total(F.transform(x, lambda v: v * v))


def autocorrelation(x: Column, order: int) -> Column:
    """The sums of products of values 0 to ``order`` places apart."""
    one = lambda i: total(F.zip_with(F.slice(x, F.lit(1), F.size(x) - i), F.slice(x, i + 1, F.size(x) - i), lambda a, b: a * b))
    return F.transform(F.sequence(F.lit(0), F.lit(order)), one)


def raised(a: Column, k: Column) -> Column:
    """Filter taps 0 to i of taps 0 to i - 1 and the next reflection coefficient."""
    zero = F.array(F.lit(0.0))
    return F.zip_with(F.concat(a, zero), F.concat(zero, F.reverse(a)), lambda x, y: x + k * y)


def reflection(lags: Column, order: int) -> Column:
    """k, the reflection coefficients (within 0.999), and error, what they leave of the energy, from lags 0 to ``order``."""
    acc = "struct<a: array<double>, k: array<double>, error: double>"

    def step(s: Column, i: Column) -> Column:
        against = total(F.zip_with(s.a, F.reverse(F.slice(lags, F.lit(2), i)), lambda x, y: x * y))
        clipped = F.coalesce(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.try_divide(-against, s.error))), F.lit(0.0))
        return let(clipped, lambda k: F.struct(raised(s.a, k).alias("a"), F.concat(s.k, F.array(k)).alias("k"), (s.error * (1 - k * k)).alias("error")).cast(acc))

    start = F.struct(F.array(F.lit(1.0)).alias("a"), F.array().cast("array<double>").alias("k"), F.get(lags, F.lit(0)).alias("error")).cast(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step, lambda s: F.struct(s.k.alias("k"), s.error.alias("error")))


def direct_form(k: Column) -> Column:
    """Filter taps 0 to p of reflection coefficients."""
    return F.aggregate(k, F.array(F.lit(1.0)), raised)


def filtered(x: Column, taps: Column) -> Column:
    """Each value with the taps' shares of those before it."""
    return F.transform(x, lambda _, t: total(F.transform(taps, lambda a, j: a * F.coalesce(F.get(x, t - j), F.lit(0.0)))))


def quantized(k: Column) -> Column:
    """Coefficients in steps of 4 bits of their arc sine, restored."""

    def one(v: Column) -> Column:
        down = F.when(v >= 0, 7.5).otherwise(8.5) / F.lit(pi / 2)
        index = F.greatest(F.lit(-8.0), F.least(F.lit(7.0), (F.asin(v) * down + F.when(v >= 0, 0.5).otherwise(-0.5)).cast("long").cast("double")))
        return F.sin(index / (F.when(index >= 0, 7.5).otherwise(8.5) / F.lit(pi / 2)))

    return F.transform(k, one)


def predicted(spectra: DataFrame, keep: list[str], order: int = 8, least_gain: float = 1.4, edges: Sequence[int] | None = None) -> DataFrame:
    """For each spectrum that a predictor along the lines helps, the columns ``keep``, gain, k (quantized to 4 bits and
    restored), kept_gain (what those leave), filter_order, length (bands declared, to the spectrum's top) and residual
    (the spectrum, with the predicted range filtered).

    With ``edges`` of bands, the predictor covers those from first_band to past_band (columns of spectra); bands count
    by equal RMS, and spectra whose bands are about equally loud are left out as noise. Without, it covers all lines as
    they are. Left out too: silent spectra, ranges of no more lines than the order, perfect fits, filters of small
    coefficients only, and those whose gain is under ``least_gain`` before or after quantizing."""
    col = F.col
    edge = lambda i: F.element_at(F.array(*[F.lit(e) for e in edges]), i + 1)
    begin, end = (edge(col("first_band")), edge(col("past_band"))) if edges else (F.lit(0), F.size("spec"))
    bounds = ["first_band", "past_band"] if edges else [F.lit(0).alias("first_band"), F.lit(1).alias("past_band")]
    own = spectra.select(F.struct(*keep).alias("kept"), col("spec").cast("array<double>").alias("spec"), *bounds).where("first_band < past_band")
    own = own.select("kept", "spec", "first_band", "past_band", begin.alias("start"), end.alias("stop")).where(col("stop") - col("start") > order)
    found = "struct<gain: double, k: array<double>, kept_gain: double, filter_order: int, residual: array<double>>"

    def tried(x: Column, w: Column, lags: Column, fit: Column, restored: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(restored, lambda v, i: F.when(F.abs(v) >= 0.1, i + 1))), F.lit(0))  # small ones after it are left out
        energy, none = F.get(lags, F.lit(0)), F.lit(None).cast(found)

        def kept(n: Column, k: Column, taps: Column) -> Column:
            left = energy / F.greatest(squared(filtered(w, taps)), F.lit(SILENT))
            residual = F.concat(F.slice("spec", F.lit(1), col("start")), filtered(x, taps), F.slice("spec", col("stop") + 1, F.size("spec")))
            return let(left, lambda g: F.when(g >= least_gain, F.struct((energy / fit.error).alias("gain"), k.alias("k"), g.alias("kept_gain"), n.alias("filter_order"), residual.alias("residual")).cast(found)))

        cut = lambda n: F.transform(restored, lambda v, i: F.when(i < n, v).otherwise(0.0))
        return let(last, lambda n: F.when(n > 0, let(cut(n), lambda k: let(direct_form(k), lambda taps: kept(n, k, taps)))).otherwise(none))

    def fitted(x: Column, w: Column) -> Column:
        helps = lambda lags, fit: (fit.error > SILENT) & (F.get(lags, F.lit(0)) >= least_gain * fit.error)
        return let(autocorrelation(w, order), lambda lags: let(reflection(lags, order), lambda fit: F.when(helps(lags, fit), let(quantized(fit.k), lambda r: tried(x, w, lags, fit, r)))))

    def weighed(x: Column) -> Column:
        """Each band divided by its RMS, unless all bands are about equally loud."""
        bands = F.transform(F.sequence("first_band", col("past_band") - 1), lambda b: F.slice(x, edge(b) - col("start") + 1, edge(b + 1) - edge(b)))
        mean = lambda a: total(a) / F.size(a)
        flat = lambda heard: F.exp(mean(F.transform(heard, F.ln))) / mean(heard) > NOISE
        scaled = lambda bands, rms: let(F.greatest(F.array_max(rms) * FLOOR, F.lit(SILENT)), lambda low: F.flatten(F.zip_with(bands, rms, lambda b, r: F.transform(b, lambda v: v / F.greatest(r, low)))))
        rms = lambda bands: F.transform(bands, lambda b: F.sqrt(squared(b) / F.size(b)))
        return let(bands, lambda b: let(rms(b), lambda r: F.when(~flat(F.transform(r, lambda v: F.greatest(v, F.lit(SILENT)))), let(scaled(b, r), lambda w: fitted(x, w)))))

    x = F.slice("spec", col("start") + 1, col("stop") - col("start"))
    made = let(x, lambda x: F.when(squared(x) >= SILENT, weighed(x) if edges else fitted(x, x)))
    length = ((len(edges) - 1 if edges else 1) - col("first_band")).cast("int").alias("length")
    helped = own.select("kept", length, F.explode(F.array(made)).alias("p")).where("p is not null")
    return helped.select("kept.*", "p.gain", "p.k", "p.kept_gain", "p.filter_order", "length", "p.residual")
