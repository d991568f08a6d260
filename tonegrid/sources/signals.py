"""Signal views of tables: what the operators take for streams, samples, spectra and parameters.

A sample view has (stream_id, sample_no, x), a spectrum view (stream_id, frame_no, spec), a parameter view one row for
each stream. A table with a natural order key becomes a stream; values are used as they are, or less a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Standard sample rates, by index.
RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000)

#: Order of lineitem rows; rows that still tie share their price.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, stream: str, order: tuple[str, ...], value: str) -> DataFrame:
    """stream_id, sample_no (from 0) and x. One window over each stream: streams are the unit of parallelism."""
    w = Window.partitionBy(stream).orderBy(*order)
    return df.select(F.col(stream).alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("sample_no"), F.col(value).cast("double").alias("x"))


def numbered_in_ranges(df: DataFrame, stream: str, order: tuple[str, ...], value: str, ranges: int = 200) -> DataFrame:
    """The same for streams of any length: rows are dealt over ``ranges`` of stream and order, so that a long stream lies in
    many of them; a row's place is its place in its range and the rows of its stream in the ranges before. Ranges are kept
    as written, so that counting them and numbering them see the same."""
    keyed = df.select(F.col(stream).alias("stream_id"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("x"))
    keys = [f"__{i}" for i in range(len(order))]
    dealt = cut(keyed.repartitionByRange(ranges, "stream_id", *keys).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy("stream_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("stream_id", "__range").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("stream_id").alias("__stream"), F.col("__range").alias("__of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range", "stream_id").orderBy(*keys))
    same = (F.col("__range") == F.col("__of")) & F.col("stream_id").eqNullSafe(F.col("__stream"))
    placed = dealt.withColumn("__own", own).join(counts, same)
    return placed.select("stream_id", (F.col("__before") + F.col("__own") - 1).cast("long").alias("sample_no"), "x")


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each user of events: many short streams."""
    return numbered(table(spark, sf_dir, "events"), "user_id", ("event_id",), "value")


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each supplier of lineitem: hundreds of samples each."""
    return numbered(table(spark, sf_dir, "lineitem"), "l_suppkey", LINE_ORDER, "l_extendedprice")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a spectrum of 64 lines, scaled to the size of a signal; its label is the stream."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("long").alias("stream_id"), F.col("vec_id").alias("frame_no"), F.transform("embedding", lambda x: x.cast("double") * 1000.0).alias("spec"))


def spectrum_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings 2i and 2i + 1 as the left and right spectrum of pair i, matched by an equi-join."""
    rows = spectra(spark, sf_dir).withColumn("pair_no", F.expr("frame_no div 2"))
    left = rows.where("frame_no % 2 = 0").select("pair_no", F.col("spec").alias("left"))
    return left.join(rows.where("frame_no % 2 = 1").select("pair_no", F.col("spec").alias("right")), "pair_no")


#: Each stream's parameters, drawn from the columns of orders. The expressions are plain enough for any SQL.
PARAMS = {
    "stream_id": "o_orderkey",
    "sample_rate": "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(RATES)) + " END",
    "channels": "o_custkey % 10",
    "bit_rate": "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 160000 END",
    "quality": "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 700 END",
    "max_bit_rate": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice * 4) AS BIGINT) ELSE 0 END",
    "bandwidth": "CASE WHEN o_custkey % 7 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 30000 ELSE 0 END",
    "mpeg_version": "CASE o_custkey % 11 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END",
    "object_type": "CASE o_orderkey % 6 WHEN 1 THEN 'LC' WHEN 2 THEN 'HE' WHEN 3 THEN 'HE2' WHEN 4 THEN 'LTP' ELSE 'AUTO' END",
    "joint_mode": "CASE o_custkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'ms' WHEN 2 THEN 'is' WHEN 3 THEN 'unknown' ELSE 'mixed' END",
    "rate_control": "CASE o_orderkey % 7 WHEN 1 THEN 'VBR' WHEN 2 THEN 'ABR' WHEN 3 THEN 'CBR' ELSE 'AUTO' END",
    "use_pns": "o_custkey % 2 = 0",
    "use_lfe": "o_custkey % 4 < 2",
}


def stream_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*[F.expr(e).cast("boolean" if k.startswith("use_") else "string" if e.endswith("' END") else "long").alias(k) for k, e in PARAMS.items()])


#: The same view for any SQL engine.
PARAMS_SQL = "SELECT " + ", ".join(f"{e} AS {k}" for k, e in PARAMS.items()) + " FROM orders"
