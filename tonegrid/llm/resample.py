"""Target-distribution importance resampling with an Aho-Corasick dictionary of words.

A text becomes words: A-Z are lower-cased and ASCII characters that are neither letters nor digits separate. A feature
is a run of 1 to ``order`` consecutive words joined by one space, and its bucket is the CRC-32 of its UTF-8 bytes modulo
the number of buckets. No such string is ever made or hashed:

* The dictionary is an automaton of distinct words with a delimiter on either side; each carries its CRC and its length
  in bytes as payload. One scan over a slice of texts emits the payloads of its words in order.
* The CRC of a run follows from the payloads of neighbours: crc(ab) = shift(crc(a), len(b)) xor crc(b), where the shift
  by a length is linear and done for whole arrays, a table for each bit of the length.

Words that the dictionary lacks lie in the gaps of the scan; their payloads are computed, and the dictionary learns them
up to a bound. It only saves work: features are the same whatever it holds.

``gains`` counts buckets over both tables, in a task first, and turns them into log ratios of target to source. A
document's weight is the mean of its features' gains; ``draw`` adds hashed Gumbel noise and takes the highest scores,
which draws without replacement in proportion to the weights' exponentials. Ranks come from counts of equal scores, in
two levels, and the order within one score, so no task ranks all rows.

Nulls: a null text has no feature; a null doc_id is hashed as an empty string and comes last among equals. Repeated rows
count each time and are drawn as rows of their own. An empty table gives an empty result, and an empty target counts of 0.
Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, checked_broadcast, cut, held, map_text, scratch, slices

#: Words that a worker's dictionary learns, and the length up to which it does.
LEARNED, LEARNED_LENGTH = 150_000, 40
#: New words after which the automaton is built again, at least.
REBUILD = 2_000
POLYNOMIAL = 0xEDB88320


def plain_bytes() -> bytes:
    """A byte for each byte: A-Z in lower case, other ASCII but digits and letters a space, the rest as it is."""
    kept = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b in kept else 32 for b in lower)


PLAIN = plain_bytes()


class Shifts:
    """What ``2**k`` zero bytes make of a CRC, as four tables of a byte each for every k."""

    def __init__(self, bits: int = 32) -> None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
        values = np.arange(256, dtype=np.uint32)
        self.tables = [[((v := values << np.uint32(8 * j)) >> np.uint32(8)) ^ one[v & np.uint32(255)] for j in range(4)]]
        for _ in range(bits - 1):
            last = self.tables[-1]
            self.tables.append([self.through(last, t) for t in last])

    @staticmethod
    def through(tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        out = tables[0][x & np.uint32(255)]
        for j in range(1, 4):
            out = out ^ tables[j][(x >> np.uint32(8 * j)) & np.uint32(255)]
        return out

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = crcs.copy()
        for k in range(int(lengths.max(initial=0)).bit_length()):
            at = np.flatnonzero((lengths >> k) & 1)
            out[at] = self.through(self.tables[k], out[at])
        return out


class Dictionary:
    def __init__(self, learned: int = LEARNED) -> None:
        self.most, self.automaton = learned, None
        self.ids: dict[str, int] = {}
        self.new: dict[str, int] = {}
        self.crcs, self.lengths = np.zeros(learned, np.uint32), np.zeros(learned, np.int64)
        self.shift = Shifts()

    def learn(self) -> None:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, i in self.new.items():
            self.automaton.add_word(f" {word} ", i)
        self.automaton.make_automaton()
        self.ids |= self.new
        self.new = {}

    def payload(self, word: str) -> tuple[int, int]:
        if (i := self.new.get(word)) is None:
            raw = word.encode()
            crc, n = zlib.crc32(raw), len(raw)
            if len(word) > LEARNED_LENGTH or (i := len(self.ids) + len(self.new)) >= self.most:
                return crc, n
            self.new[word] = i
            self.crcs[i], self.lengths[i] = crc, n
        return self.crcs[i], self.lengths[i]

    def scan(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC and length of each word of all texts, in order, and how many words each text has."""
        plain = [b" " + t.translate(PLAIN) + b" " if t else b"" for t in texts]
        whole = b"".join(plain).decode()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        gap = points == 32
        ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        crcs, lengths, known = np.zeros(len(ends), np.uint32), np.zeros(len(ends), np.int64), np.zeros(len(ends), bool)
        if self.automaton is not None and len(ends):
            found = np.fromiter(self.automaton.iter(whole), np.dtype([("end", np.int64), ("id", np.int64)]))
            at = np.searchsorted(ends, found["end"])
            crcs[at], lengths[at], known[at] = self.crcs[found["id"]], self.lengths[found["id"]], True
        if not known.all():
            starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
            for i in np.flatnonzero(~known).tolist():
                crcs[i], lengths[i] = self.payload(whole[starts[i] : ends[i]])
        # a text's end in code points: bytes that don't go on a character
        edges = np.cumsum([0] + [len(p) - int(np.count_nonzero((np.frombuffer(p, np.uint8) & 0xC0) == 0x80)) for p in plain])
        counts = np.diff(np.searchsorted(ends, edges - 1, side="right"))
        if len(self.new) > max(REBUILD, len(self.ids) // 2) or len(self.ids) + len(self.new) >= self.most > len(self.ids):
            self.learn()
        return crcs, lengths, counts

    def features(self, texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The CRCs of all runs of 1 to ``order`` words, the text each is of, and how many words each text has."""
        crcs, lengths, counts = self.scan(texts)
        text = np.repeat(np.arange(len(texts)), counts)
        out, of, run = [crcs], [text], crcs
        spaced = self.shift(np.full(len(crcs), zlib.crc32(b" "), np.uint32), lengths) ^ crcs if order > 1 else crcs
        for m in range(1, order):
            within = text[m:] == text[: len(text) - m]
            run = self.shift(run[: len(text) - m], lengths[m:] + 1) ^ spaced[m:]
            out.append(run[within])
            of.append(text[m:][within])
        return np.concatenate(out), np.concatenate(of), counts


def dictionary() -> Dictionary:
    return held("resampling words", Dictionary)


def bucket_counts(docs: DataFrame, buckets: int, order: int) -> DataFrame:
    """bucket and n over all texts. A task adds up its own, so it hands on a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = dictionary(), np.zeros(buckets, np.int64)
        for batch in batches:
            raw = batch.column(0).cast(pa.large_binary())
            sizes = pc.binary_length(raw).fill_null(0).to_pylist()
            for a, b in slices(sizes, SLICE_BYTES):
                crcs, _, _ = own.features(raw.slice(a, b - a).to_pylist(), order)
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000, order: int = 1) -> np.ndarray:
    """For each bucket floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))): s of the source's S features and
    t of the target's T lie in it. The counts that come to the driver are a row for each bucket at most."""
    s, t = (bucket_counts(x, buckets, order) for x in (source, target))
    both = s.withColumnRenamed("n", "s").join(t.withColumnRenamed("n", "t"), "bucket", "full").na.fill(0, ["s", "t"])
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    counts = every.join(F.broadcast(both), "bucket", "left").na.fill(0, ["s", "t"]).orderBy("bucket").toPandas()
    s, t = counts["s"].to_numpy(np.float64), counts["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, table: np.ndarray, order: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default), n_words, n_features and weight, the mean of the features' gains."""

    def make() -> Callable:
        own = dictionary()

        def work(texts: list) -> list:
            crcs, of, n_words = own.features(texts, order)
            n = np.bincount(of, minlength=len(texts))
            total = np.bincount(of, table[crcs % np.uint32(len(table))].astype(np.float64), minlength=len(texts)).astype(np.int64)
            return [pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]

        return work

    return map_text(docs, "text", keep or ["doc_id"], "n_words long, n_features long, weight long", make)


def noise(key: Column) -> Column:
    """floor(1000 g) of a Gumbel variable g that follows from the key."""
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def draw(weights: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """doc_id, n_features, weight, score and rank for rows of ``weighed``: of those with at least ``least_words`` words,
    ``percent`` hundredths have a rank, by score; the others a null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    with scratch(weights.sparkSession) as kept:
        rows = cut(weights.withColumn("score", F.col("weight") + noise(key)), "weights")
        fit = rows.where(F.col("n_words") >= least_words)
        # scores are sums of two bounded whole numbers, so there are few distinct ones however many rows there are
        equal = cut(fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("score") / 1000)), "scores")
        spans = equal.groupBy("span").agg(F.sum("n").alias("m"))
        higher = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.select("span", F.coalesce(F.sum("m").over(higher), F.lit(0)).alias("before"))
        within = Window.partitionBy("span").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        above = equal.join(F.broadcast(spans), "span").select("score", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("above"))
        drawn = (equal.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
        above = above.where(F.col("above") < drawn).withColumnRenamed("score", "at")
        own = ["doc_id", "n_features", "weight", "score"]
        placed = rows.join(checked_broadcast(above), (F.col("n_words") >= least_words) & (F.col("score") == F.col("at")), "left")
        among = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
        first = placed.where("above is not null").withColumn("rank", F.col("above") + F.row_number().over(among)).select(*own, F.expr(f"if(rank <= {drawn}, rank, null)").alias("rank"))
        rest = placed.where("above is null").select(*own, F.lit(None).cast("long").alias("rank"))
        kept.append(cut(first.union(rest), "drawn"))
    return kept[0]


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, order: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document: which to take to come near the target's texts."""
    return draw(weighed(docs, gains(docs, target, buckets, order), order), percent, least_words, seed)
