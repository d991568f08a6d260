"""What a review found: one test for each finding, on inputs that show it."""

import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from tonegrid.operators import transforms as T
from tonegrid.plans import assembly_queries, coding_queries
from tonegrid.sources import pcm


def quiet_coded_bands(folder):
    """Spectra with a coded band of quantized zeros (lines 40 to 51) beside bands that aren't coded (24 to 39)."""
    x = np.random.default_rng(4).normal(size=(90, 64)) / 8
    x[:, 40:52] = np.linspace(0.02, 0.08, 90)[:, None]
    pq.write_table(pa.table({"vec_id": np.arange(90), "embedding": pa.array(list(x.astype("f4")), pa.list_(pa.float32())), "label": pa.array([0] * 90, pa.int32())}), folder / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return db


def same(got, db, sql):
    columns = ", ".join(got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(db.sql(f"SELECT {columns} FROM ({sql})").fetchall())


def test_sections_beside_coded_zeros(spark, tmp_path):
    db = quiet_coded_bands(tmp_path)
    assert any(r.sfb == 7 and r.most == 0 for r in coding_queries.quantized_bands(spark, str(tmp_path)).collect())
    same(coding_queries.section_sizes(spark, str(tmp_path)), db, coding_queries.ORACLE["section_sizes"])


def test_frames_beside_coded_zeros(spark, tmp_path):
    db = quiet_coded_bands(tmp_path)
    same(assembly_queries.frame_assembly(spark, str(tmp_path)), db, assembly_queries.ORACLE["frame_assembly"])


def test_rows_without_lines_are_no_frames(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(4, 64)) / 8
    lines = [list(x[0]), None, list(x[1]), [], list(x[2, :30]), list(x[3])]
    pq.write_table(pa.table({"vec_id": range(6), "embedding": pa.array(lines, pa.list_(pa.float32())), "label": pa.array([0] * 6, pa.int32())}), tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    same(coding_queries.section_sizes(spark, str(tmp_path)), db, coding_queries.ORACLE["section_sizes"])
    same(assembly_queries.frame_assembly(spark, str(tmp_path)), db, assembly_queries.ORACLE["frame_assembly"])


def test_products_take_bounded_pieces(spark):
    def work(blocks):
        if blocks.size > 1 << 15:
            raise ValueError(f"{blocks.size} values at once")
        return blocks.sum(1, keepdims=True)

    frames = spark.range(5000, numPartitions=1).withColumn("pcm", F.array_repeat(F.col("id").cast("double"), 64))
    got = T.transformed(frames, "pcm", ["id"], "all", work).collect()
    assert sorted((r.id, r["all"]) for r in got) == [(i, [64.0 * i]) for i in range(5000)]


class Recorded:
    """Stands for a table, and keeps the function that it is given."""

    def __init__(self, spark):
        self.schema = spark.createDataFrame([], "k long, t string").schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_texts_are_decoded_in_spans(spark):
    raw = [b"a" * 20_000_003, b"", None, *[b"xyz" * 3000] * 1000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(raw, pa.binary()).cast(pa.string())], names=["k", "t"])
    run = pcm.sums(Recorded(spark), "k", "t")
    tracemalloc.start()
    (got,) = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [(len(r), *[float(pcm.decode(r, w, big).sum()) for w, big in ((1, False), (2, False), (2, True), (3, False), (4, False))]) for r in (x or b"" for x in raw)]
    assert list(zip(*[c.to_pylist() for c in got.columns[1:]])) == want
    assert peak < 60e6
