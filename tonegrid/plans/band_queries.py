"""Queries on spectral bands, over embeddings as spectra of 64 lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands as B
from ..sources.signals import spectra, spectrum_pairs

QUALITY = 40
#: Scale that makes some bands silent or noise-like beside coded ones.
SMALL = 0.02


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each band. The outer form keeps Spark from inferring a filter on the array's size and pushing it,
    with the whole computed array inlined, below the projections that make it."""
    return df.select(*keys, F.explode_outer("bands").alias("b")).select(*keys, "b.*")


def small_spectra(spark: SparkSession, sf: str) -> DataFrame:
    return spectra(spark, sf).withColumn("spec", F.transform("spec", lambda x, i: x * F.when((i >= 24) & (i < 40), 0.00002).when(F.col("frame_no") % 3 == 0, SMALL).otherwise(1.0)))


def band_energies(spark: SparkSession, sf: str) -> DataFrame:
    found = exploded(B.long_bands(spectra(spark, sf)), "frame_no")
    return found.select("frame_no", "sfb", F.round("energy", 4).alias("energy"), F.round("peak", 4).alias("peak"))


def grouped_band_energies(spark: SparkSession, sf: str) -> DataFrame:
    found = exploded(B.short_bands(spectra(spark, sf), (0, 2, 4, 8), windows=8), "frame_no")
    return found.select("frame_no", "sfb", F.round("energy", 4).alias("energy"), F.round("peak", 4).alias("peak"))


def masking(spark: SparkSession, sf: str) -> DataFrame:
    found = exploded(B.masking_targets(B.long_bands(small_spectra(spark, sf)), F.lit(QUALITY), slope=3.0), "frame_no")
    return found.select("frame_no", "sfb", F.round("target", 6).alias("target"))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return B.decisions(B.masking_targets(B.long_bands(small_spectra(spark, sf)), F.lit(QUALITY)), pns_level=4)


def band_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(decided(spark, sf), "frame_no").select("frame_no", "sfb", "kind", "level", "sfac")


def smoothed_scalefactors(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(B.smoothed(decided(spark, sf)), "frame_no").select("frame_no", "sfb", "sfac")


def scalefactor_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The sent scalefactors of each frame's coded bands, and the first of them as its global gain."""
    found = B.resolved_chain(B.smoothed(decided(spark, sf)))
    return found.select("frame_no", F.concat_ws(",", F.transform("chain", lambda c: c.sent.cast("string"))).alias("sent"), F.coalesce(F.get("chain", F.lit(0)).sent, F.lit(0)).alias("global_gain"))


def quantized_bands(spark: SparkSession, sf: str) -> DataFrame:
    """For each coded band: largest and summed quantized magnitude, and the lowest codebook that holds them."""
    found = B.resolved_chain(B.smoothed(decided(spark, sf))).select("frame_no", "spec", F.explode_outer("chain").alias("c")).where("c is not null")
    edges = F.array(*[F.lit(x) for x in B.EDGES_64])
    lo, hi = F.get(edges, F.col("c.sfb")), F.get(edges, F.col("c.sfb") + 1)
    q = F.transform(F.slice("spec", lo + 1, hi - lo), lambda x: F.abs(B.quantized(x, B.gain(F.col("c.sfac")))))
    found = found.select("frame_no", F.col("c.sfb").alias("sfb"), q.alias("q"))
    most = F.array_max("q")
    return found.select("frame_no", "sfb", most.alias("most"), F.aggregate("q", F.lit(0), lambda s, x: s + x).alias("total"), B.book_floor(most).alias("book"))


def pair_energies(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(B.pair_bands(spectrum_pairs(spark, sf)), "pair_no").select("pair_no", "sfb", *[F.round(c, 4).alias(c) for c in ("el", "er", "elr")])


def stereo_choices(spark: SparkSession, sf: str) -> DataFrame:
    found = B.pair_bands(spectrum_pairs(spark, sf)).select("pair_no", F.explode_outer("bands").alias("b"))
    sf_, pan = B.intensity_position(F.col("b"))
    chosen = B.stereo_decision(F.col("b"), ms_end=4, is_start=4, quality=QUALITY)
    return found.select("pair_no", F.col("b.sfb").alias("sfb"), chosen.alias("choice"), sf_.alias("position"), pan.alias("pan"), F.when(pan > 30, "left").when(pan < -30, "right").otherwise("none").alias("silenced"))


def mid_side(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sums of the mid and side spectra, and of the in-phase downmix at the left's energy."""
    pairs = spectrum_pairs(spark, sf)
    half = lambda sign: F.zip_with("left", "right", lambda a, b: (a + sign * b) / 2)
    weigh = lambda c: F.round(B.total(F.transform(c, lambda x, i: x * (i + 1))), 4)
    return pairs.select("pair_no", weigh(half(1)).alias("mid"), weigh(half(-1)).alias("side"))


def spectrum_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelations at lags 0 to 4 and spectral flatness of the bands' means."""
    found = B.long_bands(spectra(spark, sf))
    rms = F.transform("bands", lambda b: F.sqrt(b.energy / (b.hi - b.lo)))
    lags = B.autocorrelation(F.col("spec"), 4)
    return found.select("frame_no", *[F.round(F.get(lags, F.lit(k)), 3).alias(f"r{k}") for k in range(5)], F.round(B.flatness(rms), 8).alias("flatness"))


def prediction_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed short filter along each spectrum, and its first reflection coefficient quantized and restored."""
    found = spectra(spark, sf).withColumn("y", B.fir(F.col("spec"), (-0.5, 0.25, -0.125)))
    r = B.autocorrelation(F.col("spec"), 1)
    k = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.get(r, F.lit(1)) / F.get(r, F.lit(0))))
    found = found.withColumn("index", B.reflection_index(k))
    return found.select("frame_no", F.round(B.total(F.transform("y", lambda x, i: x * (i + 1))), 4).alias("filtered"), "index", F.round(B.reflection_value(F.col("index")), 9).alias("restored"))


QUERIES = {
    f.__name__: f
    for f in (
        band_energies, grouped_band_energies, masking, band_decisions, smoothed_scalefactors, scalefactor_chain, quantized_bands, pair_energies, stereo_choices, mid_side, spectrum_shape, prediction_filter,
    )
}

SPEC_SQL = "spec AS (SELECT vec_id AS frame_no, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE * 1000.0 AS x FROM embeddings)"
BANDS_SQL = "layout AS (SELECT i AS sfb, e[i + 1] AS lo, e[i + 2] AS hi FROM (SELECT [" + ", ".join(map(str, B.EDGES_64)) + "] AS e), range(9) t(i))"
SMALL_SQL = f"{SPEC_SQL}, small AS (SELECT frame_no, i, x * CASE WHEN i >= 24 AND i < 40 THEN 0.00002::DOUBLE WHEN frame_no % 3 = 0 THEN {SMALL}::DOUBLE ELSE 1 END AS x FROM spec)"
TARGET_SQL = f"""{SMALL_SQL}, {BANDS_SQL}, b AS (SELECT frame_no, sfb, lo, hi, sum(x * x) AS energy, max(x * x) AS peak FROM small JOIN layout ON i >= lo AND i < hi GROUP BY ALL),
    g AS (SELECT *, sum(energy) OVER (PARTITION BY frame_no) AS whole FROM b), ref AS (SELECT *, whole / 64 * (hi - lo) AS ref FROM g),
    target AS (SELECT *, CASE WHEN whole < 0.16::DOUBLE * 64 THEN 0 ELSE (0.2::DOUBLE * pow(greatest(energy, ref * 0.001::DOUBLE) / ref, 0.4) + 0.36::DOUBLE * pow(greatest(peak, ref * 0.005::DOUBLE) / ref, 0.4))
        * 10 / (1 + (lo + hi) * SLOPE / 64) * CASE WHEN energy < 0.0003::DOUBLE * ref THEN sqrt(pow(energy / (0.0003::DOUBLE * ref), 0.4)) ELSE 1 END * {QUALITY} / 100 END AS target FROM ref)"""
DECIDED_SQL = TARGET_SQL.replace("SLOPE", "1.0::DOUBLE") + """, wish AS (SELECT *, CASE WHEN target > 0 AND energy > 0 THEN round_even(13.2877::DOUBLE * log10(target) - 6.6439::DOUBLE * log10(energy) + 6.6439::DOUBLE * log10(hi - lo), 0)::INT END AS s FROM target),
    decided AS (SELECT frame_no, sfb, lo, hi, energy, peak, k AS kind, CASE WHEN k = 'noise' THEN round_even(6.6439::DOUBLE * log10(energy), 0)::INT END AS level, CASE WHEN k = 'coded' THEN s END AS sfac
        FROM (SELECT *, CASE WHEN sqrt(energy / (hi - lo)) < 0.4 OR target = 0 THEN 'zero' WHEN target < 0.4::DOUBLE THEN 'noise' WHEN 100 - s < 10 THEN 'zero' ELSE 'coded' END AS k FROM wish))"""
SMOOTH_SQL = DECIDED_SQL + """, beside AS (SELECT *, lag(sfac) OVER w AS p, lead(sfac) OVER w AS n FROM decided WINDOW w AS (PARTITION BY frame_no ORDER BY sfb)),
    smooth AS (SELECT * EXCLUDE (sfac), CASE WHEN sfac IS NULL THEN NULL ELSE least(90, sfac + CASE WHEN p IS NULL AND n IS NULL THEN 0
        ELSE round_even(0.6::DOUBLE * (-sfac - (-(coalesce(p, 0) + coalesce(n, 0))::DOUBLE / ((p IS NOT NULL)::INT + (n IS NOT NULL)::INT))), 0) END)::INT END AS sfac FROM beside)"""
MOST = (B.LARGEST + 1 - B.ROUND_UP) ** (4 / 3)
CHAIN_SQL = SMOOTH_SQL + f""", coded AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY sfb) AS k,
        100 - CASE WHEN peak > 0 AND pow(2.0, sfac / 4.0) * sqrt(peak) > {MOST!r} THEN floor(4 * log2({MOST!r} / sqrt(peak)))::INT ELSE sfac END AS first FROM smooth WHERE kind = 'coded'),
    chain AS (SELECT frame_no, sfb, k, greatest(0, least(255, first)) AS sent FROM coded WHERE k = 1
        UNION ALL SELECT c.frame_no, c.sfb, c.k, greatest(0, least(255, p.sent + greatest(-60, least(60, c.first - p.sent)))) FROM chain p JOIN coded c ON c.frame_no = p.frame_no AND c.k = p.k + 1)"""
PAIR_SQL = f"""{SPEC_SQL}, {BANDS_SQL}, lr AS (SELECT l.frame_no // 2 AS pair_no, l.i, l.x AS l, r.x AS r FROM spec l JOIN spec r ON r.frame_no = l.frame_no + 1 AND r.i = l.i WHERE l.frame_no % 2 = 0),
    pb AS (SELECT pair_no, sfb, sum(l * l) AS el, sum(r * r) AS er, sum(l * r) AS elr FROM lr JOIN layout ON i >= lo AND i < hi GROUP BY ALL)"""
LIMIT = min(2**0.5, 1 + 0.18 / (QUALITY / 100)) ** 2

ORACLE = {
    "band_energies": f"WITH {SPEC_SQL}, {BANDS_SQL} SELECT frame_no, sfb, round(sum(x * x), 4) AS energy, round(max(x * x), 4) AS peak FROM spec JOIN layout ON i >= lo AND i < hi GROUP BY 1, 2",
    "grouped_band_energies": f"""WITH {SPEC_SQL}, w AS (SELECT frame_no, i // 8 AS win, CASE WHEN i % 8 < 2 THEN 0 WHEN i % 8 < 4 THEN 1 ELSE 2 END AS sfb, sum(x * x) AS e, max(x * x) AS p FROM spec GROUP BY 1, 2, 3)
        SELECT frame_no, sfb, round(sum(e), 4) AS energy, round(avg(p), 4) AS peak FROM w GROUP BY 1, 2""",
    "masking": f"WITH {TARGET_SQL.replace('SLOPE', '3.0::DOUBLE')} SELECT frame_no, sfb, round(target, 6) AS target FROM target",
    "band_decisions": f"WITH {DECIDED_SQL} SELECT frame_no, sfb, kind, level, sfac FROM decided",
    "smoothed_scalefactors": f"WITH {SMOOTH_SQL} SELECT frame_no, sfb, sfac FROM smooth",
    "scalefactor_chain": f"WITH RECURSIVE {CHAIN_SQL} SELECT f.frame_no, coalesce(string_agg(sent, ',' ORDER BY k), '') AS sent, coalesce(min_by(sent, k), 0) AS global_gain FROM (SELECT DISTINCT frame_no FROM spec) f LEFT JOIN chain c ON c.frame_no = f.frame_no GROUP BY 1",
    "quantized_bands": f"""WITH RECURSIVE {CHAIN_SQL}, q AS (SELECT c.frame_no, c.sfb, floor(pow(abs(x) * pow(2.0, (100 - sent) / 4.0), 0.75) + 0.4054::DOUBLE)::BIGINT AS q FROM chain c JOIN layout l ON l.sfb = c.sfb JOIN small s ON s.frame_no = c.frame_no AND i >= l.lo AND i < l.hi),
        m AS (SELECT frame_no, sfb, max(q) AS most, sum(q)::BIGINT AS total FROM q GROUP BY 1, 2)
        SELECT *, CASE WHEN most = 0 THEN 0 WHEN most <= 1 THEN 1 WHEN most <= 2 THEN 3 WHEN most <= 4 THEN 5 WHEN most <= 7 THEN 7 WHEN most <= 12 THEN 9 ELSE 11 END AS book FROM m""",
    "pair_energies": f"WITH {PAIR_SQL} SELECT pair_no, sfb, round(el, 4) AS el, round(er, 4) AS er, round(elr, 4) AS elr FROM pb",
    "stereo_choices": f"""WITH {PAIR_SQL}, s AS (SELECT *, greatest(el + er + 2 * elr, 0) AS es, greatest(el + er - 2 * elr, 0) AS ed, pow(sqrt(el) + sqrt(er), 2) / {LIMIT!r} AS th,
            round_even(6.6439::DOUBLE * log10(el / (el + er)), 0)::INT AS position, round_even(6.6439::DOUBLE * log10(er / (el + er)), 0)::INT AS rpos FROM pb)
        SELECT pair_no, sfb, CASE WHEN el + er <= 0 THEN 'lr' WHEN sfb < 4 AND es * ed < 4 * el * er THEN 'ms' WHEN sfb >= 4 AND es >= th THEN 'in_phase' WHEN sfb >= 4 AND ed >= th THEN 'anti_phase' ELSE 'lr' END AS choice,
            position, rpos - position AS pan, CASE WHEN rpos - position > 30 THEN 'left' WHEN rpos - position < -30 THEN 'right' ELSE 'none' END AS silenced FROM s""",
    "mid_side": f"WITH {PAIR_SQL} SELECT pair_no, round(sum((l + r) / 2 * (i + 1)), 4) AS mid, round(sum((l - r) / 2 * (i + 1)), 4) AS side FROM lr GROUP BY 1",
    "spectrum_shape": f"""WITH {SPEC_SQL}, {BANDS_SQL}, r AS (SELECT a.frame_no, {", ".join(f"round(sum(a.x * b.x) FILTER (WHERE b.i = a.i + {k}), 3) AS r{k}" for k in range(5))} FROM spec a JOIN spec b ON b.frame_no = a.frame_no AND b.i BETWEEN a.i AND a.i + 4 GROUP BY 1),
        f AS (SELECT frame_no, exp(avg(ln(rms))) / avg(rms) AS flatness FROM (SELECT frame_no, sqrt(sum(x * x) / (hi - lo)) AS rms FROM spec JOIN layout ON i >= lo AND i < hi GROUP BY frame_no, sfb, lo, hi) GROUP BY 1)
        SELECT r.*, round(flatness, 8) AS flatness FROM r JOIN f USING (frame_no)""",
    "prediction_filter": f"""WITH {SPEC_SQL}, y AS (SELECT frame_no, i, x, lag(x) OVER w AS p, x - 0.5::DOUBLE * coalesce(lag(x) OVER w, 0) + 0.25::DOUBLE * coalesce(lag(x, 2) OVER w, 0) - 0.125::DOUBLE * coalesce(lag(x, 3) OVER w, 0) AS y FROM spec WINDOW w AS (PARTITION BY frame_no ORDER BY i)),
        a AS (SELECT frame_no, round(sum(y * (i + 1)), 4) AS filtered, greatest(-0.999::DOUBLE, least(0.999::DOUBLE, sum(x * p) / sum(x * x))) AS k FROM y GROUP BY 1),
        q AS (SELECT frame_no, filtered, greatest(-8, least(7, CASE WHEN k >= 0 THEN floor(asin(k) / (pi() / 2) * 7.5 + 0.5) ELSE ceil(asin(k) / (pi() / 2) * 8.5 - 0.5) END))::INT AS index FROM a)
        SELECT frame_no, filtered, index, round(sin(CASE WHEN index >= 0 THEN index * (pi() / 2) / 7.5 ELSE index * (pi() / 2) / 8.5 END), 9) AS restored FROM q""",
}
