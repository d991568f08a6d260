"""Queries on channel pairs as they are sent, on cutoffs by rate, and on streams as callers hand them over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as X
from ..functions import config as C
from ..operators import bands as B
from ..sources import pcm
from ..sources.signals import spectrum_pairs, stream_params, table
from .band_queries import ORACLE as BAND_ORACLE
from .band_queries import PAIR_SQL, QUALITY
from .book_queries import HEX_SQL
from .config_queries import RESOLVED_SQL
from .frame_queries import ORACLE as FRAME_ORACLE
from .frame_queries import digest, window_groups

N_BANDS, CHANNELS, CENTRE, LFE = len(B.EDGES_64) - 1, 3, 2, 1


def chosen_bands(spark: SparkSession, sf: str) -> DataFrame:
    """pair_no and bands: of each pair's right channel, how it is coded and with which value."""
    _, pan = B.intensity_position(F.col("b"))
    choice = B.stereo_decision(F.col("b"), ms_end=4, is_start=4, quality=QUALITY)
    level = F.rint(B.HALF_STEP * F.log10("b.er")).cast("int")
    rows = B.pair_bands(spectrum_pairs(spark, sf)).select("pair_no", F.explode("bands").alias("b"))
    kind = F.when(F.col("b.er") <= 0, "zero").when(choice.isin("in_phase", "anti_phase"), "intensity").when(F.col("b.sfb") % 5 == 3, "noise").otherwise("coded")
    rows = rows.select("pair_no", F.col("b.sfb").alias("sfb"), kind.alias("kind"), choice.alias("choice"), level.alias("level"), pan.alias("pan"))
    value = F.when(F.col("kind") == "intensity", F.col("pan")).when(F.col("kind") == "noise", F.col("level") - 40).when(F.col("sfb") % 2 == 0, F.col("level") * 3).otherwise(F.col("level"))
    return rows.groupBy("pair_no").agg(F.array_sort(F.collect_list(F.struct("sfb", "kind", value.alias("value"), "choice"))).alias("bands"))


def sent_scalefactors(spark: SparkSession, sf: str) -> DataFrame:
    """What is sent for each band of a pair's right channel, along its own kind's chain, and what that restores."""
    found = chosen_bands(spark, sf).select("pair_no", F.explode(B.sent_scalefactors(F.col("bands"))).alias("s"))
    return found.select("pair_no", "s.*")


def pair_heads(spark: SparkSession, sf: str) -> DataFrame:
    """The fields before each pair's data; bands that became noise are no longer coded as middle and side."""
    ms = F.transform("bands", lambda b: (b.choice == "ms") & (b.kind != "noise"))
    head, n = X.pair_head(F.col("pair_no") % 16, F.col("pair_no") % 4, F.lit(N_BANDS), ms, N_BANDS)
    return chosen_bands(spark, sf).select("pair_no", head.alias("head"), n.alias("n_bits"))


def window_infos(spark: SparkSession, sf: str) -> DataFrame:
    """The window's fields of each frame, its kind by the frame's number; short ones with their groups."""
    found = window_groups(spark, sf).withColumn("lens", F.transform(F.split("groups", ","), lambda x: x.cast("int")))
    info, n = X.window_info(F.col("frame_no") % 4, F.col("frame_no") % 13, F.col("lens"))
    return found.select("frame_no", info.alias("info"), n.alias("n_bits"))


def intensity_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose bands from the fifth on the left channel carries for both."""
    return B.intensity_spectra(spectrum_pairs(spark, sf), first_band=4).select("pair_no", digest("left").alias("left"), digest("right").alias("right"))


def leading_zeros(spark: SparkSession, sf: str) -> DataFrame:
    x = F.floor(F.col("value") * 1000).cast("long") * (F.col("event_id") % 7)
    return table(spark, sf, "events").select("event_id", X.leading_zeros(x).cast("long").alias("zeros"))


def rate_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Coded bands of each stream on the layout of its own rate, and the bandwidth at their upper edge."""
    p = C.resolved(stream_params(spark, sf))
    found = C.with_layout(p, C.rate_index(F.col("core_rate")), C.band_layouts())
    coded = F.filter("layout", lambda b: b.lo < C.div(F.col("bandwidth") * 2048, F.col("core_rate")))
    top = F.coalesce(F.array_max(F.transform(coded, lambda b: b.hi)), F.lit(0)).cast("long")
    return found.select("stream_id", F.size(coded).alias("n_bands"), top.alias("n_lines"), C.div(top * F.col("core_rate"), 2048).alias("snapped"))


def ingested_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as interleaved streams of three channels in three formats: samples of each channel and their sum."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("s16", "s24", "s32")]), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"), kind.alias("kind"))
    found = pcm.ingested(docs, "doc_id", "raw", "kind", pcm.channel_map(CHANNELS, CENTRE, LFE))
    return found.select("doc_id", "channel", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


QUERIES = {f.__name__: f for f in (sent_scalefactors, pair_heads, window_infos, intensity_spectra, leading_zeros, rate_cutoffs, ingested_streams)}

CHOSEN_SQL = f"""c AS ({BAND_ORACLE["stereo_choices"]}), {PAIR_SQL.replace("WITH ", "")},
    k AS (SELECT pair_no, sfb, choice, pan, round_even(6.6439::DOUBLE * log10(er), 0)::INT AS level, CASE WHEN er <= 0 THEN 'zero' WHEN choice IN ('in_phase', 'anti_phase') THEN 'intensity' WHEN sfb % 5 = 3 THEN 'noise' ELSE 'coded' END AS kind FROM pb JOIN c USING (pair_no, sfb)),
    v AS (SELECT *, CASE kind WHEN 'intensity' THEN pan WHEN 'noise' THEN level - 40 ELSE level * CASE WHEN sfb % 2 = 0 THEN 3 ELSE 1 END END AS value FROM k)"""
ORDER_SQL = str([pcm.channel_map(CHANNELS, CENTRE, LFE).index(c) for c in range(CHANNELS)])

ORACLE = {
    "sent_scalefactors": f"""WITH RECURSIVE {CHOSEN_SQL}, g AS (SELECT pair_no, coalesce(arg_min(value, sfb) FILTER (WHERE kind = 'coded'), 0) AS gain FROM v GROUP BY 1),
        n AS (SELECT pair_no, sfb, kind, value, row_number() OVER (PARTITION BY pair_no, kind ORDER BY sfb) AS i FROM v WHERE kind <> 'zero'),
        s AS (SELECT pair_no, kind, 0::BIGINT AS i, -1 AS sfb, 0 AS delta, CASE kind WHEN 'coded' THEN gain WHEN 'intensity' THEN 0 ELSE gain - {B.NOISE_OFFSET} END AS restored FROM (SELECT DISTINCT pair_no, kind FROM n) JOIN g USING (pair_no)
            UNION ALL SELECT pair_no, kind, i, sfb, d, restored + d FROM (SELECT n.pair_no, n.kind, n.i, n.sfb, s.restored, CASE WHEN n.kind = 'noise' AND n.i = 1 THEN n.value - s.restored ELSE greatest(-{B.MOST_DELTA}, least({B.MOST_DELTA}, n.value - s.restored)) END AS d
                FROM s JOIN n ON n.pair_no = s.pair_no AND n.kind = s.kind AND n.i = s.i + 1))
        SELECT pair_no, sfb, kind, delta, restored FROM s WHERE i > 0""",
    "pair_heads": f"""WITH {CHOSEN_SQL}, m AS (SELECT pair_no, string_agg(CASE WHEN choice = 'ms' AND kind <> 'noise' THEN '1' ELSE '0' END, '' ORDER BY sfb) AS mask FROM v GROUP BY 1),
        t AS (SELECT pair_no, '001' || lpad(bin(pair_no % 16), 4, '0') || '10' || lpad(bin(pair_no % 4), 2, '0') || '0' || lpad(bin({N_BANDS}), 6, '0') || '0' || CASE WHEN contains(mask, '1') THEN '01' || mask ELSE '00' END AS s FROM m),
        p AS (SELECT pair_no, length(s)::INT AS n_bits, s || repeat('0', (8 - length(s) % 8) % 8) AS s FROM t) SELECT pair_no, {HEX_SQL} AS head, n_bits FROM p""",
    "window_infos": f"""WITH g AS ({FRAME_ORACLE["window_groups"]}),
        f AS (SELECT g.frame_no, list_reduce([repeat('1', x::INT - 1) for x in string_split(groups, ',')], lambda a, b: a || '0' || b) AS bits FROM g),
        t AS (SELECT frame_no, '0' || lpad(bin(frame_no % 4), 2, '0') || '0' || CASE WHEN frame_no % 4 = 2 THEN lpad(bin(frame_no % 13), 4, '0') || bits ELSE lpad(bin(frame_no % 13), 6, '0') || '0' END AS s FROM f),
        p AS (SELECT frame_no, length(s)::INT AS n_bits, s || repeat('0', (8 - length(s) % 8) % 8) AS s FROM t) SELECT frame_no, {HEX_SQL} AS info, n_bits FROM p""",
    "intensity_spectra": f"""WITH {PAIR_SQL}, x AS (SELECT pair_no, i, l, r, sfb, CASE WHEN elr >= 0 THEN 1 ELSE -1 END AS sign, el + er AS whole, el + er + 2 * abs(elr) AS own FROM lr JOIN layout ON i >= lo AND i < hi JOIN pb USING (pair_no, sfb))
        SELECT pair_no, round(sum((i + 1) * CASE WHEN sfb < 4 THEN l WHEN own > 0 THEN (l + sign * r) * sqrt(whole / own) ELSE 0 END), 4) AS left, round(sum((i + 1) * CASE WHEN sfb < 4 THEN r ELSE 0 END), 4) AS right FROM x GROUP BY 1""",
    "leading_zeros": "SELECT event_id, CASE WHEN x = 0 THEN 32 ELSE 32 - length(ltrim(bin(x), '0')) END AS zeros FROM (SELECT event_id, floor(value * 1000)::BIGINT * (event_id % 7) AS x FROM events)",
    "rate_cutoffs": f"""WITH {RESOLVED_SQL}, layout(r, sfb, lo, hi) AS (VALUES {", ".join(map(str, C.band_layouts()))}),
        i AS (SELECT stream_id, core_rate, bandwidth * 2048 // core_rate AS lines, {" + ".join(f"(core_rate < {t})::INT" for t in C.RATE_THRESHOLDS)} AS r FROM resolved),
        n AS (SELECT stream_id, any_value(core_rate) AS core_rate, count(*) FILTER (WHERE lo < lines) AS n_bands, coalesce(max(hi) FILTER (WHERE lo < lines), 0)::BIGINT AS n_lines FROM i JOIN layout USING (r) GROUP BY 1)
        SELECT stream_id, n_bands::INT AS n_bands, n_lines, n_lines * core_rate // 2048 AS snapped FROM n""",
    "ingested_streams": f"""WITH w AS (SELECT doc_id, doc_id % 3 + 2 AS w, hex(encode(coalesce(text, ''))) AS h FROM documents), s AS (SELECT doc_id, w, h, unnest(range(length(h) // 2 // (w * {CHANNELS}) * {CHANNELS})) AS k FROM w),
        b AS (SELECT doc_id, w, k % {CHANNELS} AS c, [('0x' || substr(h, 2 * (k * w + j) + 1, 2))::BIGINT for j in range(w)] AS b FROM s),
        x AS (SELECT doc_id, c, (list_sum([b[j] * (256 ** (j - 1))::BIGINT for j in range(1, w + 1)]) - CASE WHEN b[w] > 127 THEN (256 ** w)::BIGINT ELSE 0 END) / CASE WHEN w = 2 THEN 1 ELSE 256 END AS x FROM b),
        t AS (SELECT doc_id, {ORDER_SQL}[c + 1] AS channel, count(*) AS n, sum(x) AS total FROM x GROUP BY 1, 2)
        SELECT d.doc_id, c.channel::INT AS channel, coalesce(n, 0) AS n, round(coalesce(total, 0), 3) AS total FROM documents d CROSS JOIN range({CHANNELS}) c(channel) LEFT JOIN t ON t.doc_id = d.doc_id AND t.channel = c.channel""",
}
