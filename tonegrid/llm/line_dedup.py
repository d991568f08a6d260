"""Line dedup by overlapping windows of three lines.

Lines with a word are hashed, A-Z as small letters and without white space at their ends; each three in a row make a
window. Of a window that is found more than once, the occurrences after the first, by doc_id and then by place, are
later ones, and all lines that later occurrences cover go. So a line goes only if it stands in the same three lines
further up in the corpus, and of each line's text the very first occurrence stays. A window's first occurrence as such
need not: its lines may be covered by a later occurrence of a neighbouring window (of ``a b c``, ``a b c d`` and ``x b c d``
in this order there remain ``a b c``, ``d`` and ``x``). Lines without a word stay.

A row is named by doc_id and a digest of its text: repeated rows with equal doc_id and text are one row here, lose
the same lines, and aren't later occurrences of each other. Nulls: a null text has no lines and stays null; a null
doc_id comes before all others. Texts of fewer than three lines have no window and stay as they are; long texts are
handled whole. An empty table gives an empty result. Extra columns stay in ``clean_lines`` and have no effect.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICES, cut, likely_in, map_text, quoted, scratch, unused

WIDTH = 3


def lines_with_words(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those with a word."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip()]


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_lines (with a word), and for each window its place and 128-bit hash; no windows: no rows."""

    def make() -> Callable:
        def one(text: bytes | None) -> tuple[list[int], list[int]]:
            lines, at = lines_with_words(text or b"")
            hashes = [xxhash.xxh3_128_digest(lines[i].strip().lower()) for i in at]
            joined = [xxhash.xxh3_128_digest(b"".join(hashes[i : i + WIDTH])) for i in range(len(at) - WIDTH + 1)]
            return [int.from_bytes(h[:8], "little", signed=True) for h in joined], [int.from_bytes(h[8:], "little", signed=True) for h in joined]

        return lambda texts: list(zip(*map(one, texts)))

    found = map_text(docs.select("doc_id", "text", digest()), "text", ["doc_id", "digest"], "h1 array<long>, h2 array<long>", make)
    return found.select("doc_id", "digest", F.posexplode(F.arrays_zip("h1", "h2")).alias("place", "h")).select("doc_id", "digest", F.col("place").cast("long").alias("place"), "h.h1", "h.h2")


def digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, digest and the places of its windows that are later occurrences, for each row that has such."""
    key = [F.col("h1"), F.col("h2")]
    with scratch(docs.sparkSession) as kept:
        found = cut(windows(docs).distinct(), "windows")
        first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "digest", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        first = cut(first, "firsts")
        # windows that stand alone go map-side; one that a great many rows have meets its first place in slices
        shared = likely_in(found, key, first, key).where("likely").drop("likely").withColumn("slice", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SLICES)))
        lead = shared.select("h1", "h2", "slice").distinct().join(first, ["h1", "h2"])
        later = shared.join(lead, ["h1", "h2", "slice"]).where(~F.struct("doc_id", "digest", "place").eqNullSafe(F.col("first")))
        kept.append(cut(later.groupBy("doc_id", "digest").agg(F.collect_list("place").alias("later")), "repeated"))
    return kept[0]


def covered(places: list[int], n: int) -> np.ndarray:
    """Which of n lines the windows at these places cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.array(places, int), 1)
    np.add.at(edges, np.array(places, int) + WIDTH, -1)
    return np.cumsum(edges[:-1]) > 0


def clean_lines(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default), clean_text, n_lines (with a word) and n_removed for each row."""
    keep = keep or ["doc_id"]
    doc, text, same, row_id, row_digest, later, likely = unused(keep, "doc", "text", "digest", "id", "d", "later", "likely")
    marks = repeated(docs).toDF(row_id, row_digest, later)
    named = docs.select(*[F.col(quoted(c)) for c in keep], F.col("doc_id").alias(doc), F.col("text").cast("string").alias(text), digest().alias(same))
    # texts without a mark stay where they are; those that likely have one are shuffled to it
    flagged = likely_in(named, [F.col(doc), F.col(same)], marks, [F.col(row_id), F.col(row_digest)], likely)
    marked = flagged.where(likely).join(marks, F.col(doc).eqNullSafe(F.col(row_id)) & (F.col(same) == F.col(row_digest)), "left")
    plain = flagged.where(~F.col(likely)).withColumn(later, F.lit(None).cast("array<long>"))
    columns = [*[F.col(quoted(c)) for c in keep], F.col(text), F.col(later)]
    joined = plain.select(*columns).union(marked.select(*columns))

    def make() -> Callable:
        def one(text: bytes | None, later: list | None) -> tuple:
            if text is None:
                return None, 0, 0
            lines, at = lines_with_words(text)
            if not later:
                return text, len(at), 0
            drop = set(np.array(at)[covered(later, len(at))].tolist())
            return b"\n".join(x for i, x in enumerate(lines) if i not in drop), len(at), len(drop)

        def work(texts: list, later: list) -> list:
            clean, n, gone = zip(*map(one, texts, later))
            return [pa.array(clean, pa.binary()).cast(pa.string()), n, gone]

        return work

    return map_text(joined, text, keep, "clean_text string, n_lines long, n_removed long", make, also=[later])
