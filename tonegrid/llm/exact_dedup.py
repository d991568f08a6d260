"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries, one in each task and then merged, find the digests that may be frequent. Their exact
counts and winners are verified, broadcast (at most ``counters`` rows) and matched map-side, so that the copies
of a hot text are never brought together. The digests that remain meet in an ordinary shuffle.

Nulls: a null text counts as empty; a null doc_id is smaller than any other. Repeated rows: of rows with the same
text and doc_id, exactly one is kept. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_keys, keep_keys, scratch


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Of one task's rows, at most ``counters`` digests with lower bounds of their counts. A digest with more
    than rows / (counters + 1) rows in the task is among them."""
    held: Counter = Counter()
    for batch in batches:
        found = batch.column(0).value_counts()
        held.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
        if len(held) > counters:
            less = sorted(held.values(), reverse=True)[counters]
            held = Counter({k: n - less for k, n in held.items() if n > less})
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["text_sha256", "least"])


def frequent(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests: all with more than 2 / (counters + 1) of the rows are among them."""
    found = digests.select("text_sha256").mapInArrow(lambda it: misra_gries(it, counters), "text_sha256 string, least long")
    return found.groupBy("text_sha256").agg(F.sum("least").alias("least")).orderBy(F.desc("least"), "text_sha256").limit(counters).select("text_sha256")


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, counters: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row. Texts are equal when ``normalise`` (by
    default no change) makes them identical; of equal texts the row with the largest doc_id is kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2((normalise(text) if normalise else text).cast("binary"), 256)
    digests = cut(docs.select("doc_id", sha.alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()), "digests")
    total = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best")]

    likely = F.broadcast(frequent(digests, counters))
    heavy = cut(digests.join(likely, "text_sha256", "left_semi").groupBy("text_sha256").agg(*total).where("group_size > 1"), "heavy")
    hot = digests.join(F.broadcast(heavy), "text_sha256")
    rest = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    cold = rest.join(rest.groupBy("text_sha256").agg(*total), "text_sha256")
    return hot.unionByName(cold).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with all their columns, without the rows that exact_dedup drops: one row of each text stays, also where
    rows repeat or have no doc_id. A row travels as one struct, so its columns may have any names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2((normalise(text) if normalise else text).cast("binary"), 256)
    key = ["id", "sha"]
    with scratch(docs.sparkSession) as kept:
        rows = exact_dedup(docs, normalise).where("group_size > 1")
        by_key = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.max("kept").alias("won"), F.count(F.lit(1)).alias("n"))
        by_key = cut(by_key.where("n > 1 or not won"), "dropped")
        kept.append(by_key)
    keyed = docs.select(F.col("doc_id").alias("id"), sha.alias("sha"), F.struct("*").alias("row"))
    out = drop_keys(keyed, by_key.select(*key), key)
    again = by_key.where("won").select(*key)  # the same text under the same doc_id: one row stays
    if not again.isEmpty():
        out = out.unionByName(keep_keys(keyed, again, key).dropDuplicates(key))
    return out.select("row.*")
