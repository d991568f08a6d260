"""Queries that put coded parts together: pairs of channels, bits of elements, frames and side payloads, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as X
from ..operators import bands as B
from ..operators import frames as W
from ..sources.signals import line_samples, spectrum_pairs, table
from .band_queries import ORACLE as BAND_ORACLE
from .band_queries import PAIR_SQL, band_decisions, quantized_bands
from .coding_queries import ORACLE as CODING_ORACLE
from .coding_queries import section_sizes, transient_grid
from .frame_queries import LENGTH
from .frame_queries import ORACLE as FRAME_ORACLE

#: Widths of the fields around the coded data; fixed by the format.
ELEMENT, TAG, GAIN, ICS_LONG, ICS_SHORT, FLAGS, END = 3, 4, 8, 11, 15, 3, 3


def intensity_downmix(spark: SparkSession, sf: str) -> DataFrame:
    """Per pair and band, the energy of the sum or difference that carries both channels, scaled to their energy."""
    found = B.pair_bands(spectrum_pairs(spark, sf)).select("pair_no", F.explode_outer("bands").alias("b"))
    in_phase = F.col("b.elr") >= 0
    own = F.col("b.el") + F.col("b.er") + F.when(in_phase, 2).otherwise(-2) * F.col("b.elr")
    scale = F.when(own > 0, F.sqrt((F.col("b.el") + F.col("b.er")) / own)).otherwise(0.0)
    return found.select("pair_no", F.col("b.sfb").alias("sfb"), in_phase.alias("in_phase"), F.round(scale, 8).alias("scale"))


def paired_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of neighbouring frames as a channel pair: noise in the left one makes a coded right one noise in the
    bands from the fifth, and the pair's last coded band is that of both."""
    rows = band_decisions(spark, sf).withColumn("pair_no", F.expr("frame_no div 2"))
    left, right = rows.where("frame_no % 2 = 0").alias("l"), rows.where("frame_no % 2 = 1").alias("r")
    both = left.join(right, (F.col("l.pair_no") == F.col("r.pair_no")) & (F.col("l.sfb") == F.col("r.sfb")))
    kind = F.when((F.col("l.kind") == "noise") & (F.col("r.kind") == "coded") & (F.col("l.sfb") >= 4), "noise").otherwise(F.col("r.kind"))
    both = both.select(F.col("l.pair_no").alias("pair_no"), F.col("l.sfb").alias("sfb"), F.col("l.kind").alias("left"), kind.alias("right"))
    last = lambda c: F.coalesce(F.max(F.when(F.col(c) != "zero", F.col("sfb") + 1)), F.lit(0))
    return both.groupBy("pair_no").agg(last("left").alias("left_bands"), last("right").alias("right_bands"), F.greatest(last("left"), last("right")).alias("max_band"), F.count_if(F.col("right") == "noise").alias("noise_right"))


def assembled(core: Column) -> Column:
    """Bits of a frame around its elements: filled up to a least size, the end marker, whole bytes."""
    fill = F.greatest(F.lit(0), 5 - core) + 6
    whole = core + fill - X.fill_left(fill) + END
    return whole + (8 - whole % 8) % 8


def frame_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of each spectrum as a frame of one channel: its sections, a fixed-length rule for magnitudes, and fields."""
    spectral = quantized_bands(spark, sf).groupBy("frame_no").agg(F.sum(F.when(F.col("most") > 0, F.floor(F.log2(F.col("most") + 0.5)) + 2).otherwise(0)).cast("long").alias("code_bits"), F.count(F.lit(1)).alias("n_coded"))
    found = section_sizes(spark, sf).join(spectral, "frame_no", "left")
    ics = GAIN + F.when(F.col("frame_no") % 4 == 0, ICS_SHORT).otherwise(ICS_LONG) + F.col("bits") + FLAGS + F.coalesce("code_bits", F.lit(0)) + 7 * F.coalesce("n_coded", F.lit(0))
    element = ELEMENT + TAG + ics
    return found.select("frame_no", element.cast("long").alias("element_bits"), assembled(element).cast("long").alias("frame_bits"))


def side_payload_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of the side payload of each frame, but for the envelope's codes: header, grid, directions, modes, noise."""
    grid = transient_grid(spark, sf)
    n = F.col("envelopes")
    header = F.when(F.col("frame_no") % 30 == 0, 22).otherwise(1)
    shape = F.when(n == 2, 2 + 4 + 2 * (n - 1) + 2 + n).otherwise(5)
    return grid.select("stream_id", "frame_no", (header + shape + n + n + 2 + 5 * n).cast("long").alias("bits"))


def analysis_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that prediction along the lines is tried on: long blocks whose attack is not weak, and no low-frequency
    channel."""
    energies = W.sub_energies(line_samples(spark, sf), LENGTH)
    kinds = W.block_types(W.wishes(W.attacks_he(energies)))
    strength = W.attack_strength(energies)
    tried = (F.col("block_type") != W.SHORT) & ~((F.col("strength") > 0) & (F.col("strength") < 0.5)).eqNullSafe(True) & (F.col("stream_id") % 6 != 5)
    return kinds.join(strength, ["stream_id", "frame_no"]).select("stream_id", "frame_no", tried.alias("tried"))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Speed and time left at each order as a mark of progress: samples done, in all, and seconds taken."""
    done, total, seconds = F.col("o_orderkey") * 1000, F.col("o_custkey") * 20000, F.floor(F.col("o_totalprice")) % 97
    speed = F.when(seconds > 0, done / 8000 / seconds).otherwise(0.0)
    left = F.when((done > 0) & (seconds > 0) & (total >= done), seconds * (total - done) / done).otherwise(0.0)
    return table(spark, sf, "orders").select("o_orderkey", speed.alias("speed"), left.alias("seconds_left"))


def quick_logarithms(spark: SparkSession, sf: str) -> DataFrame:
    """The two-term logarithm of event values: exponent, then a parabola of the rest."""
    e = F.floor(F.log2(F.when(F.col("value") > 0, F.col("value"))))  # others have none
    m = F.col("value") / F.pow(F.lit(2.0), e) - 1
    return table(spark, sf, "events").select("event_id", F.round(e + m * (1.3424 - 0.3427 * m), 8).alias("log2"))


QUERIES = {f.__name__: f for f in (intensity_downmix, paired_bands, frame_assembly, side_payload_bits, analysis_admission, progress, quick_logarithms)}

ORACLE = {
    "intensity_downmix": f"""WITH {PAIR_SQL}, o AS (SELECT pair_no, sfb, elr >= 0 AS in_phase, el + er AS whole, el + er + 2 * abs(elr) AS own FROM pb)
        SELECT pair_no, sfb, in_phase, round(CASE WHEN own > 0 THEN sqrt(whole / own) ELSE 0 END, 8) AS scale FROM o""",
    "paired_bands": f"""WITH d AS ({BAND_ORACLE["band_decisions"]}), p AS (SELECT l.frame_no // 2 AS pair_no, l.sfb, l.kind AS l, CASE WHEN l.kind = 'noise' AND r.kind = 'coded' AND l.sfb >= 4 THEN 'noise' ELSE r.kind END AS r
            FROM d l JOIN d r ON r.frame_no = l.frame_no + 1 AND r.sfb = l.sfb WHERE l.frame_no % 2 = 0),
        m AS (SELECT pair_no, coalesce(max(sfb + 1) FILTER (WHERE l <> 'zero'), 0) AS left_bands, coalesce(max(sfb + 1) FILTER (WHERE r <> 'zero'), 0) AS right_bands, count(*) FILTER (WHERE r = 'noise') AS noise_right FROM p GROUP BY 1)
        SELECT pair_no, left_bands, right_bands, greatest(left_bands, right_bands) AS max_band, noise_right FROM m""",
    "frame_assembly": f"""WITH s AS ({CODING_ORACLE["section_sizes"]}), q AS ({BAND_ORACLE["quantized_bands"]}),
        c AS (SELECT frame_no, sum(CASE WHEN most > 0 THEN floor(log2(most + 0.5)) + 2 ELSE 0 END)::BIGINT AS code_bits, count(*) AS n FROM q GROUP BY 1),
        e AS (SELECT s.frame_no, 3 + 4 + 8 + CASE WHEN s.frame_no % 4 = 0 THEN 15 ELSE 11 END + s.bits + 3 + coalesce(code_bits, 0) + 7 * coalesce(n, 0) AS element_bits FROM s LEFT JOIN c ON c.frame_no = s.frame_no),
        f AS (SELECT frame_no, element_bits, element_bits + 3 AS whole FROM e)
        SELECT frame_no, element_bits, whole + (8 - whole % 8) % 8 AS frame_bits FROM f""",
    "side_payload_bits": f"""WITH g AS ({CODING_ORACLE["transient_grid"]})
        SELECT stream_id, frame_no, CASE WHEN frame_no % 30 = 0 THEN 22 ELSE 1 END + CASE WHEN envelopes = 2 THEN 12 + 4 + 2 + 10 ELSE 5 + 2 + 2 + 5 END AS bits FROM g""",
    "analysis_admission": f"""WITH k AS ({FRAME_ORACLE["block_decisions"]}), s AS ({FRAME_ORACLE["attack_strengths"].replace("round(coalesce(max", "(coalesce(max").replace(", 0), 4) END AS strength", ", 0)) END AS strength")})
        SELECT k.stream_id, k.frame_no, block_type <> 2 AND NOT coalesce(strength > 0 AND strength < 0.5, false) AND k.stream_id % 6 <> 5 AS tried FROM k JOIN s ON s.stream_id = k.stream_id AND s.frame_no = k.frame_no""",
    "progress": """WITH p AS (SELECT o_orderkey, o_orderkey * 1000 AS done, o_custkey * 20000 AS total, floor(o_totalprice)::BIGINT % 97 AS t FROM orders)
        SELECT o_orderkey, CASE WHEN t > 0 THEN done::DOUBLE / 8000 / t ELSE 0 END AS speed, CASE WHEN done > 0 AND t > 0 AND total >= done THEN (t * (total - done))::DOUBLE / done ELSE 0 END AS seconds_left FROM p""",
    "quick_logarithms": """WITH e AS (SELECT event_id, value, floor(log2(CASE WHEN value > 0 THEN value END)) AS e FROM events), m AS (SELECT event_id, e, value / pow(2, e) - 1 AS m FROM e)
        SELECT event_id, round(e + m * (1.3424::DOUBLE - 0.3427::DOUBLE * m), 8) AS log2 FROM m""",
}
