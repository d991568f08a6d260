"""Queries that resolve each stream's parameters, over the parameter view of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config as C
from ..sources.signals import PARAMS_SQL, stream_params

#: A small band layout with widths in multiples of 4, as starts of the bands.
LONG_STARTS = [0, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768]
SHORT_STARTS = [0, 4, 8, 12, 16, 24, 32, 48, 64, 96]


def param_status(spark: SparkSession, sf: str) -> DataFrame:
    p = stream_params(spark, sf)
    return p.select("stream_id", C.status(p).alias("status"))


def param_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return C.resolved(stream_params(spark, sf)).select("stream_id", "kind", "core_rate", "rate", "control", "bandwidth", "quality", "pns_level", "treble_slope", "delay", "only_short")


def rate_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = stream_params(spark, sf)
    # rates around the standard ones, so that the thresholds matter
    rate = F.col("sample_rate") + F.col("stream_id") % 8001 - 4000
    return p.select("stream_id", rate.alias("rate"), C.rate_index(rate).alias("rate_index"), C.max_bit_rate(F.greatest(rate, F.lit(0))).alias("max_bit_rate"), C.channel_config(F.col("channels")).alias("channel_config"))


def element_layout(spark: SparkSession, sf: str) -> DataFrame:
    return C.elements(stream_params(spark, sf))


def stereo_bands(spark: SparkSession, sf: str) -> DataFrame:
    found = C.stereo_policy(C.resolved(stream_params(spark, sf)), LONG_STARTS, SHORT_STARTS)
    return found.select("stream_id", "ms_end_long", "ms_end_short", "is_start_long", "is_start_short")


def sbr_layout(spark: SparkSession, sf: str) -> DataFrame:
    found = C.sbr_bands(C.resolved(stream_params(spark, sf)).where("kind = 'HE'"))
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return found.select("stream_id", "kx", "k2", "stop_index", "n_bands", text("edges").alias("edges"), text("edges_low").alias("edges_low"), "envelopes", "crossover")


def band_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Coded bands of each stream on a small grid, and the bandwidth at their upper edge."""
    p = C.resolved(stream_params(spark, sf))
    lines = C.div(F.col("bandwidth") * 2048, F.col("core_rate"))
    n = sum((F.when(F.lit(o) < lines, 1).otherwise(0) for o in LONG_STARTS), F.lit(0))
    top = F.element_at(F.array(*[F.lit(o) for o in [*LONG_STARTS, 1024]]), (n + 1).cast("int"))
    return p.select("stream_id", n.alias("n_bands"), top.alias("n_lines"), C.div(top * F.col("core_rate"), 2048).alias("snapped"))


QUERIES = {f.__name__: f for f in (param_status, param_resolved, rate_lookup, element_layout, stereo_bands, sbr_layout, band_cutoff)}

STATUS_SQL = """CASE WHEN mpeg_version NOT IN (2, 4) THEN 'invalid' WHEN object_type = 'HE2' THEN 'unsupported'
    WHEN object_type NOT IN ('AUTO', 'LC', 'HE') OR joint_mode = 'unknown' OR NOT (channels BETWEEN 1 AND 6 OR channels = 8) OR bit_rate > sample_rate * 6
      OR (rate_control = 'VBR' AND bit_rate > 0) OR (rate_control IN ('ABR', 'CBR') AND bit_rate = 0)
      OR max_bit_rate > 100000000 OR (max_bit_rate > 0 AND bit_rate > 0 AND max_bit_rate < bit_rate * channels) THEN 'invalid' ELSE 'ok' END"""

RESOLVED_SQL = f"""
    p AS ({PARAMS_SQL}),
    k AS (SELECT *, CASE WHEN object_type <> 'AUTO' THEN object_type
              WHEN sample_rate >= 32000 AND mpeg_version <> 2 AND CASE WHEN bit_rate > 0 THEN bit_rate BETWEEN 8000 AND CASE WHEN sample_rate >= 44100 THEN 32000 ELSE 12000 + (sample_rate - 32000) * 20000 // 12100 END ELSE quality <= 75 END
              THEN 'HE' ELSE 'LC' END AS kind FROM p WHERE {STATUS_SQL} = 'ok'),
    c AS (SELECT *, CASE WHEN kind = 'HE' THEN sample_rate // 2 ELSE sample_rate END AS core_rate FROM k WHERE kind <> 'HE' OR sample_rate >= 32000),
    r AS (SELECT *, least(bit_rate, core_rate * 6) AS rate FROM c),
    s AS (SELECT *, CASE WHEN rate <= 16000 THEN 10 + 22 * (rate::DOUBLE / 16000) WHEN rate <= 64000 THEN 32 + 68 * ((rate::DOUBLE - 16000) / 48000) ELSE rate::DOUBLE / 640 END
              * CASE WHEN channels = 1 AND rate >= 32000 THEN 2.5::DOUBLE ELSE 1 END AS base FROM r),
    q AS (SELECT *, floor(base * channels * (44100.0::DOUBLE / core_rate))::BIGINT AS seed FROM s),
    resolved AS (SELECT stream_id, kind, core_rate, rate, joint_mode, sample_rate, CASE WHEN rate_control <> 'AUTO' THEN rate_control WHEN rate > 0 THEN 'ABR' ELSE 'VBR' END AS control,
        greatest(100, least(core_rate // 2, CASE WHEN bandwidth > 0 THEN bandwidth WHEN rate = 0 THEN 18750 WHEN rate <= 8000 THEN 9250 WHEN rate <= 12000 THEN 9250 + (rate - 8000) * 5 // 4
            WHEN rate <= 32000 THEN 14250 WHEN rate <= 48000 THEN 14250 + (rate - 32000) * 9 // 32 ELSE 18750 END)) AS bandwidth,
        greatest(1, least(5000, CASE WHEN quality > 0 THEN quality WHEN rate = 0 OR bandwidth > 0 OR seed = 0 THEN 100 WHEN seed > 100 THEN seed * 3 - 200 ELSE seed END)) AS quality,
        CASE WHEN NOT use_pns OR (mpeg_version = 2 AND kind <> 'HE') THEN 0 WHEN sample_rate <= 16000 AND channels = 1 THEN 2 ELSE 4 END AS pns_level,
        CASE WHEN rate >= 56000 THEN 3.0::DOUBLE ELSE 1.0 END AS treble_slope, CASE WHEN kind = 'HE' THEN 2080 ELSE 1024 END AS delay FROM q),
    full_params AS (SELECT *, kind = 'HE' AND CASE WHEN rate > 0 THEN rate < 14000 ELSE quality < 40 END AS only_short FROM resolved)"""


def starts_sql(starts: list[int], line: str) -> str:
    return "(" + " + ".join(f"({o} < {line})::INT" for o in starts) + ")"


def band_sql(starts: list[int], hz: str, width: int) -> str:
    return starts_sql(starts, f"(({hz}) * {2 * width} + core_rate - 1) // core_rate")


ORACLE = {
    "param_status": f"SELECT stream_id, {STATUS_SQL} AS status FROM ({PARAMS_SQL})",
    "param_resolved": f"WITH {RESOLVED_SQL} SELECT stream_id, kind, core_rate, rate, control, bandwidth, quality, pns_level, treble_slope, delay, only_short FROM full_params",
    "rate_lookup": f"""SELECT stream_id, rate, {" + ".join(f"(rate < {t})::INT" for t in C.RATE_THRESHOLDS)} AS rate_index, greatest(rate, 0) * 6 AS max_bit_rate,
        CASE WHEN channels BETWEEN 1 AND 6 THEN channels WHEN channels = 8 THEN 7 ELSE 0 END AS channel_config
        FROM (SELECT *, sample_rate + stream_id % 8001 - 4000 AS rate FROM ({PARAMS_SQL}))""",
    "element_layout": f"""
        WITH c AS (SELECT stream_id, channels AS n, use_lfe, unnest(range(channels)) AS ch FROM ({PARAMS_SQL})),
        e AS (SELECT *, CASE WHEN n = 2 THEN 0 WHEN ch = 0 THEN 0 ELSE 1 + (ch - 1) // 2 END AS element_no FROM c),
        g AS (SELECT stream_id, n, use_lfe, element_no, min(ch) AS ch0, CASE WHEN count(*) = 2 THEN max(ch) END AS ch1 FROM e GROUP BY ALL),
        t AS (SELECT *, CASE WHEN ch1 IS NOT NULL THEN 'CPE' WHEN ch0 > 0 AND use_lfe THEN 'LFE' ELSE 'SCE' END AS type FROM g)
        SELECT stream_id, element_no, type, row_number() OVER (PARTITION BY stream_id, type ORDER BY element_no) - 1 AS tag, ch0, ch1, type = 'LFE' AS lfe FROM t""",
    "stereo_bands": f"""
        WITH {RESOLVED_SQL}, hz AS (SELECT *,
            CASE joint_mode WHEN 'ms' THEN core_rate WHEN 'mixed' THEN CASE WHEN rate = 0 OR rate >= 40000 THEN core_rate WHEN rate >= CASE WHEN kind = 'HE' THEN 24000 ELSE 32000 END THEN core_rate WHEN kind = 'HE' AND rate >= 20000 THEN 1000 ELSE 0 END ELSE 0 END AS hz_long,
            CASE joint_mode WHEN 'ms' THEN core_rate WHEN 'mixed' THEN CASE WHEN rate = 0 OR rate >= 40000 THEN 0 WHEN rate >= CASE WHEN kind = 'HE' THEN 24000 ELSE 32000 END THEN 2000 WHEN kind = 'HE' AND rate >= 20000 THEN 1000 ELSE 0 END ELSE 0 END AS hz_short,
            least(7000, core_rate * 7 // 20) AS cap FROM resolved),
        b AS (SELECT *, {band_sql(LONG_STARTS, "hz_long", 1024)} AS ms_end_long, {band_sql(SHORT_STARTS, "hz_short", 128)} AS ms_end_short,
            CASE WHEN cap < 3500 THEN cap ELSE greatest(3500, least(cap, floor(bandwidth * 0.35::DOUBLE)::BIGINT)) END AS cross_hz FROM hz)
        SELECT stream_id, ms_end_long, ms_end_short, CASE WHEN ms_end_long > 0 THEN ms_end_long ELSE 8 END AS is_start_long,
            CASE WHEN ms_end_short > 0 THEN ms_end_short WHEN joint_mode = 'mixed' AND rate >= 80000 THEN {band_sql(SHORT_STARTS, "cross_hz", 128)} ELSE 1 END AS is_start_short FROM b""",
    "sbr_layout": f"""
        WITH {RESOLVED_SQL}, a2 AS (SELECT stream_id, rate, sample_rate AS fs, CASE WHEN sample_rate < 32000 THEN 3000 WHEN sample_rate < 64000 THEN 4000 ELSE 5000 END AS edge FROM resolved WHERE kind = 'HE'),
        b2 AS (SELECT *, (edge * 128 + fs // 2) // fs + CASE WHEN fs <= 16000 THEN 7 WHEN fs <= 22050 THEN 13 WHEN fs <= 32000 THEN 16 WHEN fs <= 64000 THEN 20 ELSE 24 END AS kx,
                  (edge * 256 + fs // 2) // fs AS low, CASE WHEN fs <= 32000 THEN 48 WHEN fs <= 44100 THEN 35 ELSE 32 END AS span FROM a2),
        c2 AS (SELECT *, [CASE i WHEN 0 THEN low WHEN 13 THEN 64 ELSE round_even(low * pow(64.0::DOUBLE / low, i / 13.0::DOUBLE), 0)::BIGINT END for i in range(14)] AS pts FROM b2),
        d2 AS (SELECT *, list_sort([pts[i + 1] - pts[i] for i in range(1, 14)]) AS w FROM c2),
        e2 AS (SELECT *, [low + coalesce(list_sum(w[1:i]), 0) for i in range(14)] AS stops FROM d2),
        f2 AS (SELECT *, len([s for s in stops if s - kx <= span]) AS n_fit, len([s for s in stops if s * fs < 20000 * 128]) AS n_below FROM e2),
        g2 AS (SELECT *, greatest(0, least(n_fit - 1, n_below))::INT AS stop_index FROM f2),
        h2 AS (SELECT *, stops[stop_index + 1]::BIGINT AS k2, CASE WHEN rate >= 12000 THEN 8 ELSE 10 END AS per FROM g2),
        j2 AS (SELECT *, greatest(1, least(64, 2 * floor(per * log2(k2::DOUBLE / kx) / 2 + 0.5)))::INT AS n FROM h2),
        k2 AS (SELECT *, [floor(kx * pow(k2::DOUBLE / kx, i::DOUBLE / n) + 0.5)::BIGINT for i in range(n + 1)] AS marks FROM j2),
        l2 AS (SELECT *, list_sort([marks[i + 1] - marks[i] for i in range(1, n + 1)]) AS steps FROM k2),
        m2 AS (SELECT *, [kx + coalesce(list_sum(steps[1:i]), 0)::BIGINT for i in range(n + 1)] AS edges FROM l2)
        SELECT stream_id, kx, k2, stop_index, n AS n_bands, array_to_string(edges, ',') AS edges,
            array_to_string([edges[CASE WHEN i = 0 THEN 1 ELSE 2 * i - n % 2 + 1 END] for i in range((n + 1) // 2 + 1)], ',') AS edges_low,
            CASE WHEN rate >= 17000 THEN 2 ELSE 1 END AS envelopes, kx * fs // 128 AS crossover FROM m2""",
    "band_cutoff": f"""
        WITH {RESOLVED_SQL}, n AS (SELECT *, {starts_sql(LONG_STARTS, "bandwidth * 2048 // core_rate")} AS n_bands FROM resolved)
        SELECT stream_id, n_bands, {[*LONG_STARTS, 1024]}[n_bands + 1] AS n_lines, {[*LONG_STARTS, 1024]}[n_bands + 1] * core_rate // 2048 AS snapped FROM n""",
}
