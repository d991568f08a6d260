"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. Each source's documents are put in a hashed order and that stream of words is cut into blocks of
equal size. A schedule of slots decides what the mix reads next: point k of the golden-ratio sequence falls into
one source's share of [0, 1), and the r-th slot of a source reads its block r mod (number of blocks), up to the
source's quota of slots. The last slot of a source reads its block in part, so that a source's words are its target,
rounded. So every stretch of the schedule holds the sources near their weights. A document is taken as often as the
slots read the words it has in their blocks.

The sequence is drawn to twice the number of slots: n of its points leave no gap over 1.9 / n, so that fills every
quota, however small. Sources are rows of one table that is ranked and summed in one task, so they may be millions,
not billions.

Targets share the total of all sizes by weight; a target stops at ``epochs`` times its source's size and the excess
goes to the others by weight (water filling, solved at once: sorted by size / weight, the sources up to some rank
are at their cap and the others share what is left).

Nulls: a null text has size 0; a null source is a source of its own, after all others; a null doc_id is a value like
any other. Documents of size 0 are taken 0 times. Repeated rows are documents of their own; rows with the same
doc_id, source and size may change places in the order, which leaves the result as it is. An empty table gives an
empty result. Extra columns are not looked at. Reruns agree: nothing depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, map_text, quoted, scratch

#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size and the key of the source's hashed order, for each row."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), order.alias("h"), *[F.col(quoted(c)).alias(f"__{c}") for c in keep])


def targets(sources: DataFrame, weights: Sequence[float], epochs: int) -> DataFrame:
    """source, source_size, sid (rank by code point, null last) and target, a row for each source."""
    whole = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= epochs * F.col("source_size"))
    # the first source in this order that isn't capped has the level of all that follow
    first = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "sid", "level"))).over(whole)["level"]
    return levels.withColumn("target", F.least(epochs * F.col("source_size"), F.coalesce(first * F.col("weight"), F.lit(float("inf")))).cast("double")).select("source", "source_size", "sid", "target")


def blocks(sources: DataFrame, grain: int) -> DataFrame:
    """Adds the number of blocks a source is cut into, its quota of slots, and the words of its last slot. Blocks have
    total / grain words at most, and a source at least 16 blocks if it has as many words."""
    most = F.greatest(F.lit(1.0), F.sum("source_size").over(Window.partitionBy()) / grain)
    n = F.greatest(F.ceil(F.col("source_size") / most), F.least(F.col("source_size"), F.lit(16)))
    wanted = sources.withColumn("n_blocks", n.cast("long")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    quota = F.when(F.col("n_blocks") > 0, F.expr("(words * n_blocks + source_size - 1) div source_size")).otherwise(0).cast("long")
    return wanted.withColumn("quota", quota).withColumn("rest", F.when(F.col("quota") > 0, F.expr("words - ((quota - 1) * source_size + n_blocks - 1) div n_blocks"))).drop("words")


def schedule(sources: DataFrame, chunk: int = 512) -> DataFrame:
    """sid and rank (of the slot within its source) for each slot k of the mix."""
    total = int(sources.agg(F.sum("quota")).first()[0] or 0)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("quota").over(before), F.lit(0))
    spans = sources.withColumn("low", low).where("quota > 0").select("sid", "quota", "low", (F.col("low") + F.col("quota")).alias("high"))
    slots = sources.sparkSession.range(2 * total).withColumn("x", F.expr(f"(id + 0.5D) * {GOLDEN}D % 1") * total)
    # each slot meets its source by the integer part of its point, in steps of a fixed number of cells
    cells = max(1, total // 4096)
    cell = spans.withColumn("cell", F.explode(F.sequence((F.col("low") / cells).cast("long"), ((F.col("high") - 1) / cells).cast("long"))))
    own = slots.withColumn("cell", (F.floor("x") / cells).cast("long")).join(cell, "cell").where("x >= low and x < high").select("id", "sid", "quota", (F.col("id") / chunk).cast("long").alias("part"))
    own = cut(own, "slots")
    # ranks within a source: those of the chunks before, then those within the chunk
    counts = own.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("c"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("c").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("sid", "part").orderBy("id")) - 1).join(ahead, ["sid", "part"])
    return ranked.select("id", "sid", (F.col("r") + F.col("ahead")).alias("rank"), "quota").where("rank < quota").drop("quota")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, grain: int = 1 << 16, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for each row."""
    words = cut(sizes(docs, keep), "sizes")
    bits = min(16, max(6, (words.count() // 1024).bit_length()))  # buckets of about 1,000 documents, or the 65,536th part
    words = words.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), 16 - bits))
    groups = cut(words.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "groups")
    sources = blocks(targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs), grain)
    sources = cut(sources, "sources")

    slots = schedule(sources).join(sources.select("sid", "n_blocks", "quota", "rest"), "sid")
    in_part = F.expr("rank = quota - 1")
    reads = slots.groupBy("sid", F.expr("rank % n_blocks").alias("block")).agg(F.count(F.when(~in_part, 1)).alias("times"), F.coalesce(F.max(F.when(in_part, F.col("rest"))), F.lit(0)).alias("head"))
    # the words of each group and each document, as ranges of its source's stream
    start = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.withColumn("base", F.coalesce(start, F.lit(0))).join(sources, groups.source.eqNullSafe(sources.source)).drop(sources.source)
    order = Window.partitionBy("source", "bucket").orderBy("h", "size")
    local = words.withColumn("local", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(order))
    same = [local.source.eqNullSafe(offsets.source), local.bucket == offsets.bucket]
    placed = local.join(offsets, same).drop(offsets.source, offsets.bucket).withColumn("at", F.col("base") + F.col("local"))
    placed = cut(placed.drop("base", "local", "words", "quota", "rest"), "placed")
    # the word at position p is in block floor(p * n / size)
    found = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr("at * n_blocks div source_size"), F.expr("(at + size - 1) * n_blocks div source_size"))))
    found = found.join(reads, ["sid", "block"]).withColumn("low", F.expr("(block * source_size + n_blocks - 1) div n_blocks")).withColumn("high", F.expr("((block + 1) * source_size + n_blocks - 1) div n_blocks"))
    part = F.expr("times * greatest(0, least(at + size, high) - greatest(at, low)) + greatest(0, least(at + size, low + head) - greatest(at, low))")
    taken = found.groupBy("sid", "bucket", "nth").agg(F.sum(part).alias("taken"))
    out = placed.join(taken, ["sid", "bucket", "nth"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *[F.col(f"__{c}").alias(c) for c in keep])


def mixed_documents(docs: DataFrame, **mix: object) -> DataFrame:
    """docs with all their columns, a row for each time the mix takes a document. Where it takes a part, once more
    than the whole times, that row's text is cut after so many words (at most one document of a source for each
    whole pass over it, and one more). Rows with a null or empty text are never taken; rows with equal doc_id, source
    and text are taken evenly. A row travels as one struct, so its columns may have any names."""
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest")
    with scratch(docs.sparkSession) as kept:
        taken = mix_sources(docs.select("doc_id", "source", "text", digest), keep=["digest"], **mix).where("taken > 0")
        taken = taken.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("same")).agg(F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"))
        kept.append(taken := cut(taken, "taken"))
    named = docs.select(F.col("doc_id").alias("key"), digest, F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    found = named.join(taken, F.col("key").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("same")))
    each = F.expr("taken div n")
    copies = found.withColumn("words", F.explode(F.concat(F.array_repeat(F.col("size"), (each / F.col("size")).cast("int")), F.when(each % F.col("size") > 0, F.array(each % F.col("size"))).otherwise(F.array()))))
    whole = copies.where("words = size").select("row.*")
    parts = copies.where("words < size")

    def make() -> Callable:
        def first_words(text: bytes, n: int) -> str:
            left = text.split(None, n)
            return (text if len(left) <= n else text[: len(text) - len(left[n])].rstrip()).decode()

        return lambda texts, n: [pa.array(map(first_words, texts, n), pa.string())]

    cut_texts = map_text(parts, "text", ["row"], "cut string", make, also=["words"])
    return whole.unionByName(cut_texts.withColumn("row", F.col("row").withField("text", F.col("cut"))).select("row.*"))
