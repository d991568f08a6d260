"""Queries on running values and on the front end across frames, over sizes and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import envelopes as E
from ..operators.filterbank import analysed
from ..operators.rate import CHANNEL_BITS, frame_budget
from ..operators.scans import clamped
from ..operators.transforms import prototype
from ..sources.signals import LINE_ORDER, line_samples, numbered_in_ranges, table
from .frame_queries import LINES_SQL, SIZES_SQL, sizes
from .frame_queries import ORACLE as FRAME_ORACLE

BANDS, SLOTS = 8, 16
BUDGET = frame_budget(2, 64_000, 48_000)
CAP = 2 * CHANNEL_BITS - BUDGET


def reservoir_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The reservoir after each user's frame, with streams in spans of 8 frames."""
    return clamped(sizes(spark, sf), BUDGET - F.col("size"), 0, CAP, CAP // 2, "fill", span=8)


def bank_energies(spark: SparkSession, sf: str) -> DataFrame:
    """Energies of eight bands in each slot of eight samples, in millions; the bank looks back over ten slots."""
    found = analysed(line_samples(spark, sf), BANDS, SLOTS).select("stream_id", "frame_no", F.posexplode("bank").alias("slot", "e"))
    return found.select("stream_id", "frame_no", F.col("slot").cast("long").alias("slot"), F.posexplode("e").alias("band", "e")).select("stream_id", "frame_no", "slot", F.col("band").cast("long").alias("band"), F.round(F.col("e") / 1e6, 4).alias("energy"))


def bank_half_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The same pass's signal at half the rate, up to each stream's end."""
    samples = line_samples(spark, sf)
    ends = samples.groupBy("stream_id").agg(F.max("sample_no").alias("last"))
    found = analysed(samples, BANDS, SLOTS).select("stream_id", "frame_no", F.posexplode("half").alias("k", "x"))
    found = found.select("stream_id", (F.col("frame_no") * (BANDS * SLOTS // 2) + F.col("k")).alias("sample_no"), F.round("x", 4).alias("x"))
    return found.join(ends, "stream_id").where(F.col("sample_no") * 2 <= F.col("last")).drop("last")


def bank_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Energies by envelope and band, in millions: four streams are an element's channels, the fourth its low-frequency
    one. The grid follows the slots' own energies, and the envelopes sum up the bank's bands; all from one pass."""
    own = analysed(line_samples(spark, sf), BANDS, SLOTS)
    keys = ["element_id", "frame_no"]
    named = own.select(F.floor(F.col("stream_id") / 4).cast("long").alias("element_id"), (F.col("stream_id") % 4).alias("channel"), (F.col("stream_id") % 4 == 3).alias("lfe"), "frame_no", F.posexplode(F.arrays_zip("bank", "slot_energy")).alias("slot", "z"))
    slots = named.select(*keys, "channel", "lfe", F.col("slot").cast("long").alias("slot"), F.col("z.slot_energy").alias("e"), "z.bank")
    grids = E.grids(E.transients(slots, [*keys, "channel", "lfe"]), keys, SLOTS)
    bands = slots.select(*keys, "channel", "lfe", "slot", F.posexplode("bank").alias("band", "e"))
    found = E.envelope_energies(bands, grids, keys, decimation=2)
    return found.select(*keys, "channel", "envelope", F.col("band").cast("long").alias("band"), F.round(F.col("energy") / 1e6, 3).alias("energy"))


def ranged_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's lines as samples, numbered in ranges, so that no stream is sorted in one task."""
    return numbered_in_ranges(table(spark, sf, "lineitem"), "l_suppkey", LINE_ORDER, "l_extendedprice", ranges=32)


QUERIES = {f.__name__: f for f in (ranged_samples, reservoir_fill, bank_energies, bank_half_rate, bank_envelopes)}

LENGTH = BANDS * SLOTS
BANK_SQL = f"""{LINES_SQL}, taps AS (SELECT unnest(range({10 * BANDS})) AS n, unnest({prototype(BANDS).tolist()}::DOUBLE[]) AS c),
    ends AS (SELECT stream_id, max(sample_no) // {LENGTH} AS last FROM samples GROUP BY 1),
    placed AS (SELECT stream_id, unnest(range((last + 1) * {SLOTS})) AS place FROM ends),
    u AS (SELECT p.stream_id, place, n % {2 * BANDS} AS j, sum(c * x) AS u FROM placed p CROSS JOIN taps JOIN samples s ON s.stream_id = p.stream_id AND s.sample_no = place * {BANDS} + {BANDS - 1} - n GROUP BY ALL),
    parts AS (SELECT stream_id, place, band, sum(u * cos(pi() * (2 * band + 1) * j / {2 * BANDS})) AS re, sum(u * sin(pi() * (2 * band + 1) * j / {2 * BANDS})) AS im FROM u, range({BANDS}) t(band) GROUP BY ALL),
    bank AS (SELECT p.stream_id, place // {SLOTS} AS frame_no, place % {SLOTS} AS slot, b.band, coalesce(re * re + im * im, 0) AS e FROM placed p CROSS JOIN range({BANDS}) b(band) LEFT JOIN parts USING (stream_id, place, band))"""

ORACLE = {
    "ranged_samples": f"WITH {LINES_SQL} SELECT * FROM samples",
    "reservoir_fill": f"""WITH RECURSIVE {SIZES_SQL}, fold AS (SELECT stream_id, -1::BIGINT AS frame_no, 0::BIGINT AS size, {CAP // 2}::BIGINT AS fill FROM sizes WHERE frame_no = 0
            UNION ALL SELECT s.stream_id, s.frame_no, s.size, least({CAP}, greatest(0, f.fill + {BUDGET} - s.size)) FROM fold f JOIN sizes s ON s.stream_id = f.stream_id AND s.frame_no = f.frame_no + 1)
        SELECT * FROM fold WHERE frame_no >= 0""",
    "bank_energies": f"WITH {BANK_SQL} SELECT stream_id, frame_no, slot, band, round(e / 1e6, 4) AS energy FROM bank",
    "bank_half_rate": FRAME_ORACLE["half_rate"],
    "bank_envelopes": f"""WITH {BANK_SQL}, se AS (SELECT p.stream_id, place // {SLOTS} AS frame_no, place % {SLOTS} AS slot, coalesce(sum(x * x), 0) AS e FROM placed p LEFT JOIN samples s ON s.stream_id = p.stream_id AND s.sample_no // {BANDS} = place GROUP BY ALL),
        t AS (SELECT stream_id // 4 AS element_id, stream_id % 4 AS channel, frame_no, slot, CASE WHEN sum(e) OVER f > 0 THEN max(e) OVER f * {SLOTS} / sum(e) OVER f ELSE 0 END AS strength, row_number() OVER (PARTITION BY stream_id, frame_no ORDER BY e DESC, slot) AS k FROM se WINDOW f AS (PARTITION BY stream_id, frame_no)),
        v AS (SELECT *, row_number() OVER (PARTITION BY element_id, frame_no ORDER BY strength DESC, channel) AS n FROM t WHERE k = 1 AND channel <> 3),
        g AS (SELECT element_id, frame_no, CASE WHEN strength > 4 THEN 2 * greatest(0, least(3, trunc((slot - 2) / 2)::INT)) + 2 ELSE 16 END AS border FROM v WHERE n = 1)
        SELECT b.stream_id // 4 AS element_id, b.frame_no, b.stream_id % 4 AS channel, CASE WHEN slot >= border THEN 1 ELSE 0 END AS envelope, band, round(sum(e) / 1e6, 3) AS energy
        FROM bank b JOIN g ON g.element_id = b.stream_id // 4 AND g.frame_no = b.frame_no WHERE b.stream_id % 4 <> 3 AND slot % 2 = 0 GROUP BY ALL""",
}
