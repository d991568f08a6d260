"""documents -> a filtered, deduplicated, mixed and encoded corpus, in stages that are each written and read again.

Every stage works on all that the one before kept, and all but the last return the columns of documents. Nulls, empty
texts, ties and repeated rows: what each stage's operator says of them; documents without words go in the first stage,
and an empty table gives an empty corpus. Extra columns of documents come along up to the last stage, under any names.

This is a job of its own: it has Arrow batches of 1,000 rows in its session, unless the session sets their size itself,
as workers of five operators share an executor's memory and documents are long rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import cut, documents, forget, scratch
from tonegrid.llm.exact_dedup import distinct_documents
from tonegrid.llm.near_dedup import distinct_groups
from tonegrid.llm.pieces import Vocabulary, encode
from tonegrid.llm.quality_rules import accepted
from tonegrid.llm.queries import TOKENIZERS
from tonegrid.llm.source_mix import mixed_documents

#: Sketches, hashed orders and piece ids can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


BATCH_ROWS, SPARK_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_ROWS, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(BATCH_ROWS, "1000")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those without text among them."""
    small_batches(spark)
    return accepted(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: that with the largest doc_id."""
    return distinct_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five words, similarity of 0.8 or more) the one with the smallest doc_id stays."""
    return distinct_groups(docs, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, cut to the words taken where it takes a part."""
    return mixed_documents(docs, weights=(5, 2, 1), epochs=3).withColumn("n_chars", F.length("text").cast("long"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_pieces of each row."""
    return encode(docs, Vocabulary.load(f"{TOKENIZERS}/piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mix", mix_stage),
    ("pieces", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            kept.append(docs := cut(stage(spark, docs, sf_dir), name))
        if before:
            forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
