"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in chunks, once with each dictionary; (bytes with the good one - bytes with the bad one) / bytes
of the text is the normalised difference, and a logistic curve fitted on labelled texts that no dictionary has seen
makes it a probability. The fit uses a bounded sample of whole texts: at most ``sample`` labelled doc_ids of each label
and ``sample_bytes`` bytes of their texts, taken in the order of a hash of doc_id; a text that is longer than what is
left of these bytes is passed over. Scores cover whole texts; only the text is an input.

Nulls and empty texts: the difference is 0, so they get the curve's value there. Labels without a quality or without
a document are not used, nor a doc_id that has both labels; of several texts with one doc_id the one with the smallest
digest is used, so the model doesn't depend on partitions. If a label has no rows at all, every score is the share of
label 1 (0.5 without labels).
Rows are scored one by one, so repeated rows get equal results. An empty table gives an empty result. Extra columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, map_text, scratch

CHUNK, LEVEL = 512, 3


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text is the dictionary
        return b"".join(samples)[-size:]


def differences(good: bytes, bad: bytes) -> Callable:
    """A function of texts that returns their normalised differences."""

    def compressor(raw: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False)

    with_good, with_bad = compressor(good).compress, compressor(bad).compress

    def one(text: bytes | None) -> float:
        if not text:
            return 0.0
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return (sum(len(with_good(c)) for c in chunks) - sum(len(with_bad(c)) for c in chunks)) / len(text)

    return lambda texts: list(map(one, texts))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit with a small ridge, by Newton's method."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    a, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-2 * w
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(2), gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def within(rows: list[tuple], most: int) -> list[tuple]:
    """Of rows (h, bytes, ...), in order, those that fit together into ``most`` bytes."""
    taken, left = [], most
    for row in sorted(rows):
        if row[1] <= left:
            taken.append(row)
            left -= row[1]
    return taken


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, size: int = 1 << 18, sample_bytes: int = 16 << 20) -> Model | float:
    """The model, or the constant score if a label has no rows. labels: doc_id and label (0 or 1)."""
    with scratch(docs.sparkSession):
        return fitted(docs, labels, sample, size, sample_bytes)


def fitted(docs: DataFrame, labels: DataFrame, sample: int, size: int, sample_bytes: int) -> Model | float:
    labels = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label"), F.max(F.col("label").cast("int")).alias("other"))
    labels = labels.where("label = other").drop("other")
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    constant = good / (good + bad) if good + bad else 0.5
    h = F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = [labels.where(F.col("label") == k).withColumn("h", h).orderBy("h", "doc_id").limit(sample) for k in (0, 1)]
    chosen = chosen[0].union(chosen[1])  # at most 2 * sample rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # texts are looked through once; only the chosen rows are hashed, and all that follows reads those
    texts = cut(docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)), "labelled")
    found = texts.groupBy("h", "label", "doc_id").agg(F.min(F.struct("sha", F.octet_length("text").alias("n"))).alias("one")).select("h", "one.n", "label", "doc_id", "one.sha").collect()
    used = [row for k in (0, 1) for row in within([tuple(r) for r in found if r["label"] == k], sample_bytes)]
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, sha) for _, _, _, i, sha in used], StructType([labels.schema["doc_id"], *StructType.fromDDL("sha string")]))
    rows = texts.join(F.broadcast(wanted), ["doc_id", "sha"]).dropDuplicates(["doc_id"])
    # the last bit of h's first eight digits decides between dictionary and curve
    rows = rows.withColumn("train", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % 2 == 0)
    whole = sorted((r["h"], r["label"], r["text"].encode()) for r in rows.where("train").select("h", "label", "text").collect())
    by_label = {k: [t[i : i + CHUNK] for _, label, t in whole if label == k for i in range(0, len(t), CHUNK)] for k in (0, 1)}
    if not all(by_label.values()):
        return constant
    own = dictionary(by_label[1], size), dictionary(by_label[0], size)
    held = map_text(rows.where("not train"), "text", ["h", "label"], "x double", lambda: lambda texts: [differences(*own)(texts)]).collect()
    held = sorted((r["h"], r["label"], r["x"]) for r in held)
    y, x = np.array([r[1] for r in held]), np.array([r[2] for r in held], float)
    share = {k: int((y == k).sum()) for k in (0, 1)}
    if not all(share.values()):
        return constant
    weight = np.where(y == 1, good / share[1], bad / share[0])
    return Model(*own, *logistic(x, y.astype(float), weight / weight.mean()))


def score_quality(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score (probability of label 1) for each row."""
    if not isinstance(model, Model):
        return docs.select("doc_id", F.lit(float(model)).alias("score"))

    def make() -> Callable:
        of = differences(model.good, model.bad)
        return lambda texts: [1 / (1 + np.exp(-np.clip(model.slope * np.array(of(texts)) + model.offset, -50, 50)))]

    return map_text(docs, "text", ["doc_id"], "score double", make)
