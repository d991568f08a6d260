"""Queries on frames, sub-blocks and block decisions, over sample views of events and lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as W
from ..sources.signals import LINE_ORDER, line_samples, spectra, user_samples

#: Frame length of these queries: streams of the tables are short.
LENGTH = 64


def digest(column: str) -> Column:
    """An array's weighted sum, so that order counts."""
    return F.round(F.aggregate(F.transform(column, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4)


def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    return W.frames(line_samples(spark, sf), LENGTH, lead=1).select("stream_id", "frame_no", F.size("pcm").alias("n"), digest("pcm").alias("weighted"))


def frame_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    framed = W.neighbours(W.frames(line_samples(spark, sf), LENGTH), LENGTH)
    return framed.select("stream_id", "frame_no", digest("past").alias("past"), digest("pcm").alias("current"), digest("ahead1").alias("ahead1"), digest("ahead2").alias("ahead2"))


def emitted_frames(spark: SparkSession, sf: str) -> DataFrame:
    return W.emitted(user_samples(spark, sf), LENGTH)


def sub_block_energy(spark: SparkSession, sf: str) -> DataFrame:
    return W.sub_energies(line_samples(spark, sf), LENGTH).withColumn("energy", F.round("energy", 3))


def attacks_high_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return W.attacks_he(W.sub_energies(line_samples(spark, sf), LENGTH)).select("stream_id", "sub_no", "attack")


def attacks_low_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return W.attacks_lc(W.sub_energies(line_samples(spark, sf), LENGTH)).select("stream_id", "sub_no", F.round("level", 2).alias("level"), "attack")


def block_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: which frames of each stream need short blocks."""
    decided = W.block_types(W.wishes(W.attacks_he(W.sub_energies(line_samples(spark, sf), LENGTH))))
    control = F.element_at(F.array(F.lit("normal"), F.lit("normal"), F.lit("no_short"), F.lit("no_long")), (F.col("stream_id") % 4 + 1).cast("int"))
    return decided.select("stream_id", "frame_no", "wish", "block_type", W.forced_types(F.col("block_type"), F.col("stream_id") % 6 == 5, control).alias("forced_type"))


def attack_strengths(spark: SparkSession, sf: str) -> DataFrame:
    return W.attack_strength(W.sub_energies(line_samples(spark, sf), LENGTH)).withColumn("strength", F.round("strength", 4))


def payload_delay(spark: SparkSession, sf: str) -> DataFrame:
    rows = sizes(spark, sf)
    return W.delayed(rows, "size", 3, F.lit(-1).cast("long")).select("stream_id", "frame_no", "delayed", (F.col("frame_no") % 30 == 0).alias("header"))


def half_rate(spark: SparkSession, sf: str) -> DataFrame:
    return W.decimate(line_samples(spark, sf)).withColumn("x", F.round("x", 4))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Frame sizes: each user's events in order, tenths of the value."""
    return user_samples(spark, sf).select("stream_id", F.col("sample_no").alias("frame_no"), F.floor(F.col("x") * 10).cast("long").alias("size"))


def frame_durations(spark: SparkSession, sf: str) -> DataFrame:
    w = W.by_stream("frame_no").rowsBetween(W.Window.unboundedPreceding, 0)
    placed = sizes(spark, sf).withColumn("position", F.sum("size").over(w))
    return W.rounded_durations(placed, 7).select("stream_id", "frame_no", "duration")


def duration_runs(spark: SparkSession, sf: str) -> DataFrame:
    coarse = sizes(spark, sf).withColumn("delta", F.expr("size div 1500"))
    return W.runs(coarse, "delta")


def peak_bit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return W.peak_rate(sizes(spark, sf), sample_rate=8000, frame_samples=1024)


def window_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each spectrum as eight windows of four bands of two lines."""
    e = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.pow(F.get("spec", w * 8 + b * 2), 2.0) + F.pow(F.get("spec", w * 8 + b * 2 + 1), 2.0)))
    found = W.group_windows(spectra(spark, sf).withColumn("energy", e), first_band=1)
    return found.select("frame_no", F.concat_ws(",", F.col("groups").cast("array<string>")).alias("groups"))


def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Frames, bytes, largest frame and average rate of each stream."""
    return sizes(spark, sf).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("size").alias("bytes"), F.max("size").alias("max_frame"), F.floor(F.sum("size") * 8 * 8000 / (F.count(F.lit(1)) * 1024)).cast("long").alias("avg_rate"))


QUERIES = {
    f.__name__: f
    for f in (
        block_decisions, stream_frames, frame_neighbours, emitted_frames, sub_block_energy, attacks_high_efficiency, attacks_low_complexity, attack_strengths,
        payload_delay, half_rate, frame_durations, duration_runs, peak_bit_rate, window_groups, stream_summary,
    )
}

LINES_SQL = f"samples AS (SELECT l_suppkey AS stream_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS sample_no, l_extendedprice AS x FROM lineitem)"
USERS_SQL = "samples AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample_no, value AS x FROM events)"
SIZES_SQL = f"{USERS_SQL}, sizes AS (SELECT stream_id, sample_no AS frame_no, floor(x * 10)::BIGINT AS size FROM samples)"
ENERGY_SQL = f"""{LINES_SQL}, d AS (SELECT *, x - coalesce(lag(x) OVER (PARTITION BY stream_id ORDER BY sample_no), 0) AS d FROM samples),
    windows AS (SELECT DISTINCT stream_id, (sample_no - 28) // 8 AS sub_no FROM samples WHERE sample_no >= 28),
    energies AS (SELECT w.stream_id, sub_no, sum(d * d) AS energy FROM windows w JOIN d ON d.stream_id = w.stream_id AND sample_no >= 28 + 8 * sub_no AND sample_no < 44 + 8 * sub_no GROUP BY ALL)"""
HE_SQL = f"""{ENERGY_SQL}, levels AS (SELECT *, coalesce(lag(energy) OVER (PARTITION BY stream_id ORDER BY sub_no), 0) AS level FROM energies),
    attacked AS (SELECT stream_id, sub_no, energy > level * 1.5 OR energy * 1.5 < level AS attack FROM levels)"""

ORACLE = {
    "stream_frames": f"WITH {LINES_SQL} SELECT stream_id, (sample_no + 1) // 64 AS frame_no, 64 AS n, round(sum(x * ((sample_no + 1) % 64 + 1)), 4) AS weighted FROM samples GROUP BY 1, 2",
    "frame_neighbours": f"""WITH {LINES_SQL}, f AS (SELECT stream_id, sample_no // 64 AS frame_no, sum(x * (sample_no % 64 + 1)) AS v FROM samples GROUP BY 1, 2)
        SELECT stream_id, frame_no, round(coalesce(lag(v) OVER w, 0), 4) AS past, round(v, 4) AS current, round(coalesce(lead(v) OVER w, 0), 4) AS ahead1, round(coalesce(lead(v, 2) OVER w, 0), 4) AS ahead2
        FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no)""",
    "emitted_frames": "SELECT user_id AS stream_id, count(*) AS n_samples, (count(*) + 63) // 64 + 1 AS frames_lc, (count(*) + 128) // 128 + 2 AS frames_he FROM events GROUP BY user_id",
    "sub_block_energy": f"WITH {ENERGY_SQL} SELECT stream_id, sub_no, round(energy, 3) AS energy FROM energies",
    "attacks_high_efficiency": f"WITH {HE_SQL} SELECT * FROM attacked",
    "attacks_low_complexity": f"""WITH RECURSIVE {ENERGY_SQL}, fold AS (
            SELECT stream_id, sub_no, energy, 0.0::DOUBLE AS level FROM energies WHERE sub_no = 0
            UNION ALL SELECT e.stream_id, e.sub_no, e.energy, 0.3 * f.energy + 0.7 * f.level FROM fold f JOIN energies e ON e.stream_id = f.stream_id AND e.sub_no = f.sub_no + 1)
        SELECT stream_id, sub_no, round(level, 2) AS level, energy > 2.5 * level OR energy * 12 < level AS attack FROM fold""",
    "block_decisions": f"""WITH RECURSIVE {HE_SQL}, frames AS (SELECT stream_id, sub_no // 8 AS frame_no FROM attacked GROUP BY ALL),
        wishes AS (SELECT f.stream_id, f.frame_no, coalesce(bool_or(attack), false) AS wish FROM frames f LEFT JOIN attacked a ON a.stream_id = f.stream_id AND a.sub_no BETWEEN 8 * f.frame_no - 9 AND 8 * f.frame_no + 1 GROUP BY ALL),
        machine AS (
            SELECT stream_id, frame_no, wish, 2 AS block_type FROM wishes WHERE frame_no = 0
            UNION ALL SELECT w.stream_id, w.frame_no, w.wish, CASE WHEN w.wish OR m.wish THEN CASE WHEN m.block_type IN (0, 3) THEN 1 ELSE 2 END ELSE CASE WHEN m.block_type IN (1, 2) THEN 3 ELSE 0 END END
            FROM machine m JOIN wishes w ON w.stream_id = m.stream_id AND w.frame_no = m.frame_no + 1)
        SELECT *, CASE WHEN stream_id % 6 = 5 OR stream_id % 4 = 2 THEN 0 WHEN stream_id % 4 = 3 THEN 2 ELSE block_type END AS forced_type FROM machine""",
    "attack_strengths": f"""WITH {ENERGY_SQL}, j AS (SELECT *, lag(energy) OVER (PARTITION BY stream_id, sub_no // 8 ORDER BY sub_no) AS p FROM energies)
        SELECT stream_id, sub_no // 8 AS frame_no, CASE WHEN bool_or(least(energy, p) = 0 AND energy <> p) THEN NULL ELSE round(coalesce(max(abs(energy - p) / CASE WHEN least(energy, p) > 0 THEN least(energy, p) END), 0), 4) END AS strength FROM j GROUP BY 1, 2""",
    "payload_delay": f"WITH {SIZES_SQL} SELECT s.stream_id, s.frame_no, coalesce(o.size, -1) AS delayed, s.frame_no % 30 = 0 AS header FROM sizes s LEFT JOIN sizes o ON o.stream_id = s.stream_id AND o.frame_no = s.frame_no - 3",
    "half_rate": f"""WITH {LINES_SQL}, taps AS (SELECT unnest({[62 - 2 * j for j in range(16)] + [2 * j for j in range(16)] + [31]}) AS back, unnest({[*W.HALF_BAND, *W.HALF_BAND, W.HALF_BAND_CENTRE]}::DOUBLE[]) AS tap)
        SELECT s.stream_id, s.sample_no // 2 AS sample_no, round(sum(o.x * tap), 4) AS x FROM samples s CROSS JOIN taps LEFT JOIN samples o ON o.stream_id = s.stream_id AND o.sample_no = s.sample_no - back WHERE s.sample_no % 2 = 0 GROUP BY 1, 2""",
    "frame_durations": f"""WITH {SIZES_SQL}, r AS (SELECT stream_id, frame_no, (sum(size) OVER (PARTITION BY stream_id ORDER BY frame_no) + 3)::BIGINT // 7 AS pos FROM sizes)
        SELECT stream_id, frame_no, pos - coalesce(lag(pos) OVER (PARTITION BY stream_id ORDER BY frame_no), 0) AS duration FROM r""",
    "duration_runs": f"""WITH {SIZES_SQL}, g AS (SELECT stream_id, frame_no, size // 1500 AS delta, frame_no - row_number() OVER (PARTITION BY stream_id, size // 1500 ORDER BY frame_no) AS island FROM sizes),
        r AS (SELECT stream_id, delta, count(*) AS n, min(frame_no) AS start FROM g GROUP BY stream_id, delta, island)
        SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start) AS run_no, delta, n FROM r""",
    "peak_bit_rate": f"""WITH {SIZES_SQL}, w AS (SELECT stream_id, frame_no // 8 AS win, sum(size)::BIGINT AS bytes, count(*) AS n FROM sizes GROUP BY 1, 2)
        SELECT stream_id, coalesce(max(bytes * 8 * 8000 // 8192) FILTER (WHERE n = 8), 0) AS peak_rate FROM w GROUP BY 1""",
    "window_groups": """WITH RECURSIVE e AS (SELECT vec_id AS frame_no, w, [(embedding[w * 8 + b * 2 + 1]::DOUBLE * 1000) ** 2 + (embedding[w * 8 + b * 2 + 2]::DOUBLE * 1000) ** 2 for b in range(1, 4)] AS v FROM embeddings, range(8) t(w)),
        fold AS (SELECT frame_no, w, v AS lo, v AS hi, 1 AS n, []::INT[] AS lens FROM e WHERE w = 0
            UNION ALL SELECT frame_no, w, CASE WHEN cut THEN v ELSE lo END, CASE WHEN cut THEN v ELSE hi END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN list_append(lens, n) ELSE lens END
            FROM (SELECT *, list_sum([(hi[i] > 3 * lo[i])::INT for i in range(1, 4)]) > 2 AS cut FROM (
                SELECT e.frame_no, e.w, e.v, [least(f.lo[i], e.v[i]) for i in range(1, 4)] AS lo, [greatest(f.hi[i], e.v[i]) for i in range(1, 4)] AS hi, f.n, f.lens FROM fold f JOIN e ON e.frame_no = f.frame_no AND e.w = f.w + 1)))
        SELECT frame_no, array_to_string(list_append(lens, n), ',') AS groups FROM fold WHERE w = 7""",
    "stream_summary": f"WITH {SIZES_SQL} SELECT stream_id, count(*) AS n_frames, sum(size)::BIGINT AS bytes, max(size) AS max_frame, sum(size)::BIGINT * 64000 // (count(*) * 1024) AS avg_rate FROM sizes GROUP BY 1",
}
