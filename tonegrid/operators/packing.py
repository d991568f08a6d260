"""Fields of any width packed into a stream of bits, the most significant bit first, by aggregations only.

A field's place is the sum of the widths before it, in two levels: within spans of fields, and over the spans' totals. It
is cut where words of 32 bits meet, a word is the OR of its fields' parts, and a stream's words come out in chunks, so no
stream stands in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.containers import frame_offsets

WORD = 32


def packed(fields: DataFrame, span: int = 1024, chunk_words: int = 256) -> DataFrame:
    """stream_id, chunk_no, n_bits and hex: fields (stream_id, frame_no from 0 without gaps, value, width of 0 to 32 bits) in
    chunks of so many words, the last byte filled up with zeros. Of a value only the lowest ``width`` bits count."""
    known = fields.where("width > 0").select("stream_id", "frame_no", F.col("width").cast("bigint").alias("size"), F.expr("cast(value as bigint) & (shiftleft(1L, cast(width as int)) - 1)").alias("value"))
    placed = frame_offsets(known, span).withColumn("word", F.expr(f"offset div {WORD}")).withColumn("over", F.expr(f"cast(offset % {WORD} + size - {WORD} as int)"))
    # what reaches beyond the word goes to the next one
    first = F.when(F.col("over") > 0, F.expr("shiftright(value, over)")).otherwise(F.expr("shiftleft(value, -over)"))
    rest = F.when(F.col("over") > 0, F.expr(f"shiftleft(value & (shiftleft(1L, over) - 1), {WORD} - over)"))
    parts = F.array(F.struct(F.col("word"), first.alias("bits"), F.least(F.lit(0), F.col("over")).alias("unused")), F.struct((F.col("word") + 1).alias("word"), rest.alias("bits"), (F.col("over") - WORD).alias("unused")))
    each = placed.select("stream_id", F.explode(parts).alias("p")).where("p.bits is not null").select("stream_id", "p.*")
    words = each.groupBy("stream_id", "word").agg(F.bit_or("bits").alias("bits"), F.max("unused").alias("unused"))
    n_bits = F.count(F.lit(1)) * WORD + F.min("unused")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", F.lpad(F.hex("bits"), WORD // 4, "0").alias("hex")))), lambda w: w.hex), "")
    chunks = words.groupBy("stream_id", F.expr(f"word div {chunk_words}").alias("chunk_no")).agg(n_bits.cast("bigint").alias("n_bits"), text.alias("text"))
    return chunks.select("stream_id", "chunk_no", "n_bits", F.expr("substring(text, 1, cast(2 * ceil(n_bits / 8) as int))").alias("hex"))
