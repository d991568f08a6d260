"""Token counts by an exact length histogram.

Whole texts are encoded and only the lengths are kept, aggregated to one row for each distinct length. Suffix sums
over that histogram answer, for a context limit of any length: documents and tokens at or over it, tokens that fit
under it (truncated total), tokens in all; quantiles are read off the same sums.

Nulls: a null text has 0 tokens, as an empty one. Special tokens' strings are ordinary text. Repeated rows count each
time. An empty table gives an empty histogram, and answers of 0 or null. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence

import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held, map_text


def ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and ranks; read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def content(merges: dict[bytes, int]) -> str:
    """A digest of all tokens and ranks, under which a worker keeps their encoder."""
    return xxhash.xxh3_128_hexdigest(b"".join(b"%d %d " % (len(t), r) + t for t, r in sorted(merges.items())))


def token_lengths(docs: DataFrame, merges: dict[bytes, int], pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) and n_tokens for each row."""
    name = ("tokens", content(merges), pattern)

    def make() -> Callable:
        encode = held(name, lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})).encode_ordinary
        return lambda texts: [[len(encode(t.decode())) if t else 0 for t in texts]]

    return map_text(docs, "text", keep or ["doc_id"], "n_tokens long", make)


def length_histogram(lengths: DataFrame, span: int = 1024) -> DataFrame:
    """For each distinct n_tokens: n_docs, docs_at_most, docs_at_least, tokens_at_least and truncated_total, the
    tokens left when every document is cut to n_tokens. The sums over all lengths are made in two levels: within
    ``span`` consecutive lengths, and over the totals of the spans."""
    # texts are encoded once: the table of distinct lengths serves the sums over spans and those within
    counts = cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths").withColumn("span", F.expr(f"n_tokens div {span}"))
    whole = [F.sum("n_docs").alias("span_docs"), F.sum(F.expr("n_docs * n_tokens")).alias("span_tokens")]
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("span").agg(*whole)
    everything = Window.partitionBy()
    spans = spans.select(
        "span", F.coalesce(F.sum("span_docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("span_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("span_docs").over(everything).alias("all_docs"), F.sum("span_tokens").over(everything).alias("all_tokens"),
    )
    down = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    inside = counts.withColumn("d", F.sum("n_docs").over(down)).withColumn("t", F.sum(F.expr("n_docs * n_tokens")).over(down))
    summed = inside.join(spans, "span").withColumn("docs_at_least", F.expr("d + docs_after")).withColumn("tokens_at_least", F.expr("t + tokens_after"))
    return summed.select("n_tokens", "n_docs", F.expr("all_docs - docs_at_least + n_docs").alias("docs_at_most"), "docs_at_least", "tokens_at_least", F.expr("all_tokens - tokens_at_least + n_tokens * docs_at_least").alias("truncated_total"))


def next_lengths(histogram: DataFrame, served: Column, asked: Sequence[float]) -> DataFrame:
    """k and row, for the k-th of the sorted values asked for: the row of the smallest n_tokens that serves more than k
    of them (null if none does). ``served``: how many of the values, in order, a row serves; it never falls as n_tokens
    grows. One aggregation to a row for each value, and a window over those."""
    own = F.struct("n_tokens", "n_docs", "docs_at_most", "docs_at_least", "tokens_at_least", "truncated_total")
    firsts = histogram.groupBy((served - 1).cast("int").alias("k")).agg(F.min(own).alias("row"))
    every = histogram.sparkSession.range(len(asked)).select(F.col("id").cast("int").alias("k"))
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return every.join(firsts, "k", "left").select("k", F.last("row", ignorenulls=True).over(up).alias("row"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, docs_over (longer ones) and truncated_total for each limit asked for, read off the suffix sums
    of the smallest length that is at or over the limit. A limit asked for twice gets one row."""
    asked = sorted({int(x) for x in limits})
    served = F.size(F.filter(F.lit(asked).cast("array<long>"), lambda x: x <= F.col("n_tokens")))
    found = next_lengths(histogram, served, asked).withColumn("context_limit", F.element_at(F.lit(asked).cast("array<long>"), F.col("k") + 1))
    total = F.coalesce(histogram.agg(F.max("truncated_total")).scalar(), F.lit(0))  # the longest length cuts nothing
    over = F.expr("row.docs_at_least - if(row.n_tokens = context_limit, row.n_docs, 0)")
    cut_off = F.coalesce(F.expr("row.tokens_at_least - row.docs_at_least * context_limit"), F.lit(0))
    return found.select("context_limit", F.coalesce(over, F.lit(0)).alias("docs_over"), (total - cut_off).alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share and n_tokens, the smallest length that at least that share of the documents doesn't exceed."""
    asked = sorted({float(x) for x in shares})
    total = F.expr("docs_at_most + docs_at_least - n_docs")  # of all documents, in each row
    served = F.size(F.filter(F.lit(asked).cast("array<double>"), lambda x: x * total <= F.col("docs_at_most")))
    found = next_lengths(histogram, served, asked)
    return found.select(F.element_at(F.lit(asked).cast("array<double>"), F.col("k") + 1).alias("share"), F.col("row.n_tokens").alias("n_tokens"))
