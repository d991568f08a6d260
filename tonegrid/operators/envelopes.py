"""Time grids of a frame's envelopes: the strongest channel's transient decides for its whole element, and the energies of
the slots are summed up by envelope and band. Everything is grouped by element and frame, so no stream stays whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME_SLOTS, STRONG = 16, 4.0


def transients(slots: DataFrame, keys: list[str]) -> DataFrame:
    """For each of ``keys``: strength (the largest slot energy against the mean) and slot (the first largest). slots: the
    keys, slot and e. Without energy the strength is 0 and the slot the first."""
    found = slots.groupBy(*keys).agg(F.max("e").alias("most"), F.sum("e").alias("total"), F.count(F.lit(1)).alias("n"), F.min_by("slot", F.struct(-F.col("e"), "slot")).alias("slot"))
    return found.select(*keys, F.when(F.col("total") > 0, F.col("most") * F.col("n") / F.col("total")).otherwise(0.0).alias("strength"), "slot")


def grids(found: DataFrame, keys: list[str], n_slots: int, steady: int = 1) -> DataFrame:
    """For each element's frame (``keys``): strength, slot, envelopes, and border, in slots, where the second envelope
    starts (the end of the frame, if there is one envelope). The strongest channel that isn't low-frequency decides, the
    first of equals; a strong transient gives two envelopes, else there are ``steady`` (1 or 2) equal ones. found: the
    keys, channel, lfe, strength and slot."""
    voters = found.groupBy(*keys).agg(F.min_by(F.when(~F.col("lfe"), F.struct("strength", "slot")), F.when(~F.col("lfe"), F.struct(-F.col("strength"), F.col("channel")))).alias("v"))
    named = voters.select(*keys, F.coalesce("v.strength", F.lit(0.0)).alias("strength"), F.coalesce("v.slot", F.lit(0)).cast("long").alias("slot"))
    at = F.expr(f"slot * {TIME_SLOTS} div {n_slots}")
    inner = 2 * F.greatest(F.lit(0), F.least(F.lit(3), F.expr("cast((place - 2) / 2 as int)"))) + 2
    border = F.when(F.col("strength") > STRONG, inner).otherwise(TIME_SLOTS // 2 if steady == 2 else TIME_SLOTS)
    gridded = named.withColumn("place", at).withColumn("envelopes", F.when(F.col("strength") > STRONG, 2).otherwise(steady))
    return gridded.withColumn("border", F.floor(border * n_slots / TIME_SLOTS).cast("long")).drop("place")


def envelope_of(slot: Column, border: Column) -> Column:
    """The envelope that a slot falls into: a range lookup in at most two ranges."""
    return F.when(slot >= border, 1).otherwise(0)


def sampled_slots(gridded: DataFrame, keys: list[str], n_slots: int, decimation: int = 1) -> DataFrame:
    """The slots of each envelope that are analysed when only every ``decimation``-th slot is: ``sampled``, 1 at least."""
    last = F.col("envelopes") - 1
    each = gridded.select(*keys, "border", "envelopes", F.explode(F.sequence(F.lit(0), last)).alias("envelope"))
    before = F.ceil(F.col("border") / decimation)  # analysed slots before the border
    every = -(-n_slots // decimation)
    n = F.when(F.col("envelope") == 1, every - F.least(F.lit(every), before)).otherwise(F.least(F.lit(every), before))
    return each.select(*keys, "envelope", F.greatest(F.lit(1), n).cast("long").alias("sampled"))


def envelope_energies(slots: DataFrame, gridded: DataFrame, keys: list[str], decimation: int = 1) -> DataFrame:
    """The keys, channel, envelope, band and energy: the analysed slots' band energies summed up. slots: the keys,
    channel, lfe, slot, band and e; low-frequency channels have no envelopes."""
    used = slots.where(~F.col("lfe") & (F.col("slot") % decimation == 0))
    placed = used.join(gridded.select(*keys, "border"), keys).withColumn("envelope", envelope_of(F.col("slot"), F.col("border")))
    return placed.groupBy(*keys, "channel", "envelope", "band").agg(F.sum("e").alias("energy"))
