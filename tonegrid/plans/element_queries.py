"""Queries on elements of several channels, on layouts by rate and on options, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as X
from ..functions import config as C
from ..operators import bands as B
from ..operators import envelopes as E
from ..operators import frames as W
from ..operators.prediction import PREDICTED_BANDS
from ..sinks.containers import adts_chunks
from ..sources.signals import PARAMS_SQL, line_samples, spectrum_pairs, stream_params, table
from .coding_queries import payloads
from .frame_queries import HE_SQL, LENGTH, LINES_SQL, SIZES_SQL, sizes
from .frame_queries import ORACLE as FRAME_ORACLE

KEYS, SLOTS, DECIMATION = ["element_id", "frame_no"], 16, 2


def slot_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Four streams are the channels of an element, the fourth its low-frequency one; a frame has 16 slots of 4 samples."""
    at = F.col("sample_no") % 64
    return line_samples(spark, sf).select(
        F.floor(F.col("stream_id") / 4).cast("long").alias("element_id"), (F.col("stream_id") % 4).alias("channel"), (F.col("stream_id") % 4 == 3).alias("lfe"),
        F.floor(F.col("sample_no") / 64).cast("long").alias("frame_no"), F.floor(at / 4).cast("long").alias("slot"), (at % 4).alias("pos"), "x",
    )


def gridded(spark: SparkSession, sf: str) -> DataFrame:
    slots = slot_samples(spark, sf).groupBy(*KEYS, "channel", "lfe", "slot").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    return E.grids(E.transients(slots, [*KEYS, "channel", "lfe"]), KEYS, SLOTS)


def element_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Each element's frame: the strongest channel's transient, envelopes and border."""
    return gridded(spark, sf).withColumn("strength", F.round("strength", 6))


def slot_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """How many of every second slot fall into each envelope."""
    return E.sampled_slots(gridded(spark, sf), KEYS, SLOTS, DECIMATION)


def envelope_energies(spark: SparkSession, sf: str) -> DataFrame:
    """Energies by envelope and band, in millions; a slot's four samples have four bands, by sums and differences."""
    signs = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, -1, 1), (1, -1, 1, -1))
    x = [F.sum(F.when(F.col("pos") == i, F.col("x")).otherwise(0.0)) for i in range(4)]
    square = lambda s: F.pow(sum((F.col(f"x{i}") * k for i, k in enumerate(s)), F.lit(0.0)) / 2, 2.0)
    slots = slot_samples(spark, sf).groupBy(*KEYS, "channel", "lfe", "slot").agg(*[c.alias(f"x{i}") for i, c in enumerate(x)])
    bands = slots.select(*KEYS, "channel", "lfe", "slot", F.posexplode(F.array(*map(square, signs))).alias("band", "e"))
    found = E.envelope_energies(bands, gridded(spark, sf), KEYS, DECIMATION)
    return found.select(*KEYS, "channel", "envelope", F.col("band").cast("long").alias("band"), F.round(F.col("energy") / 1e6, 3).alias("energy"))


def common_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of streams: frames that may be coded together. A short frame has a window group more for each attack
    within it."""
    attacked = W.attacks_he(W.sub_energies(line_samples(spark, sf), LENGTH))
    inside = F.count_if(F.col("attack") & (F.col("sub_no") % 8 > 0))
    groups = attacked.groupBy("stream_id", F.floor(F.col("sub_no") / 8).cast("long").alias("frame_no")).agg((inside + 1).alias("n"))
    typed = W.block_types(W.wishes(attacked)).join(groups, ["stream_id", "frame_no"])
    return W.common_windows(typed.withColumn("n_groups", F.when(F.col("block_type") == W.SHORT, F.col("n")).otherwise(1)))


def uneven_peak_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The largest bit rate of streams whose frames last differently."""
    duration = F.when(F.col("frame_no") % 5 == 3, 960).when(F.col("frame_no") < 2, 900).otherwise(1024)
    return W.kept_peak_rate(sizes(spark, sf).withColumn("duration", duration), 8000)


def shared_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Window groups that the two channels of a pair share: by the sums of their bands' energies."""
    line = lambda k: F.pow(F.get("left", k), 2.0) + F.pow(F.get("right", k), 2.0)
    e = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: line(w * 8 + b * 2) + line(w * 8 + b * 2 + 1)))
    found = W.group_windows(spectrum_pairs(spark, sf).withColumn("energy", e), first_band=1)
    return found.select("pair_no", F.concat_ws(",", F.col("groups").cast("array<string>")).alias("groups"))


def measured_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands of each pair's middle, every second one coded as middle and side, with nothing from line 40 on."""
    pairs = spectrum_pairs(spark, sf)
    faint = F.when(F.col("pair_no") % 3 == 0, 0.001).otherwise(1.0)
    pairs = pairs.select("pair_no", F.zip_with("left", "right", lambda x, y: (x + y) / 2 * faint).alias("mid"), *[F.transform(c, lambda x: x * faint).alias(c) for c in ("left", "right")])
    part = lambda c, b: B.squares(c, b.lo, b.hi - b.lo)
    one = lambda b: F.struct(b.sfb.alias("sfb"), b.lo.alias("lo"), b.hi.alias("hi"), B.total(part("mid", b)).alias("energy"), F.array_max(part("mid", b)).alias("peak"), B.total(part("left", b)).alias("el"), B.total(part("right", b)).alias("er"))
    bands = pairs.select("pair_no", F.explode_outer(F.transform(B.band_list(B.EDGES_64), one)).alias("b")).select("pair_no", "b.*")
    found = B.measured(bands.withColumns({"windows": F.lit(1), "ms": (F.col("pair_no") + F.col("sfb")) % 2 == 0}), cutoff=40)
    return found.select("pair_no", "sfb", F.round("coded_energy", 2).alias("energy"), F.round("coded_peak", 2).alias("peak"))


#: Options drawn from the columns of orders, for Spark; the SQL below says the same.
OPTIONS = {
    "channels": "o_custkey % 6 + 1",
    "short_control": "element_at(array('normal', 'no_short', 'no_long', 'long', 'normal', 'normal', 'normal'), cast(o_custkey % 7 + 1 as int))",
    "output_format": "if(o_orderkey % 9 = 4, 'file', if(o_orderkey % 2 = 0, 'raw', 'framed'))",
    "input_format": "element_at(array('s16', 's24', 's32', 'f32', 's16', 's16', 'u8'), cast(o_orderkey % 7 + 1 as int))",
    "reserved": "if(o_orderkey % 13 = 0, 1, 0)",
    "channel_map": """case o_custkey % 5 when 0 then null when 1 then sequence(0L, o_custkey % 6) when 2 then sequence(1L, o_custkey % 6 + 1)
        when 3 then slice(sequence(0L, o_custkey % 6), 1, cast(o_custkey % 6 as int)) else reverse(sequence(0L, o_custkey % 6)) end""",
}


def option_status(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stream_id"), *[F.expr(e).alias(k) for k, e in OPTIONS.items()])
    return p.select("stream_id", C.option_status(p).alias("status"))


def rate_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Each stream's band layout by its rate index: bands, the last band's start, and the bands a predictor covers."""
    p = stream_params(spark, sf).withColumn("rate_index", C.rate_index(F.col("sample_rate")))
    found = C.with_layout(p, F.col("rate_index"), C.band_layouts())
    ranges = spark.createDataFrame([(i, *r) for i, r in enumerate(PREDICTED_BANDS)], "rate_index int, low int, high int")
    n = F.size("layout")
    both = found.join(F.broadcast(ranges), "rate_index", "left")
    return both.select("stream_id", n.alias("n_bands"), F.element_at("layout", -1).lo.alias("last_start"), F.least("low", n).alias("first_band"), F.least("high", n).alias("past_band"))


def tag_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as bytes, every second one from within its first character beyond ASCII: whether they are UTF-8 in
    outline, and the characters of what they are read as."""
    ascii_first = F.length(F.regexp_extract("text", r"^[\x00-\x7F]*", 0))
    content = F.encode("text", "UTF-8")
    shown = F.when(F.col("doc_id") % 2 == 1, F.substring(content, ascii_first + 2, F.octet_length("text"))).otherwise(content)
    valid, text = X.utf8_text(shown)
    return table(spark, sf, "documents").select("doc_id", valid.alias("valid"), F.length(text).cast("long").alias("n_chars"), F.ascii(text).cast("long").alias("first_char"))


def spanned_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship's block decisions with streams cut into spans of 8 frames: a decision depends on 6 frames before it
    and one after."""
    chain = lambda samples: W.block_types(W.wishes(W.attacks_he(W.sub_energies(samples, LENGTH))))
    return W.over_spans(line_samples(spark, sf), chain, span=8 * LENGTH, back=6 * LENGTH, ahead=LENGTH, unit=LENGTH).select("stream_id", "frame_no", "wish", "block_type")


def spanned_half_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Streams at half their rate, in spans of 256 samples with the filter's 62 before."""
    found = W.over_spans(line_samples(spark, sf), W.decimate, span=256, back=62, ahead=0, unit=2, order="sample_no")
    return found.withColumn("x", F.round("x", 4))


def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's headed frames in chunks of 16: place in the stream's bytes, size and digest."""
    found = adts_chunks(payloads(spark, sf), F.lit(0), F.lit(4), F.lit(2), span=16)
    return found.select("stream_id", "chunk_no", "offset", F.length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (spanned_decisions, spanned_half_rate, stream_chunks, element_grids, slot_envelopes, envelope_energies, common_windows, uneven_peak_rate, shared_groups, measured_bands, option_status, rate_layouts, tag_texts)
}

GRID_SQL = f"""{LINES_SQL}, s AS (SELECT stream_id // 4 AS element_id, stream_id % 4 AS channel, sample_no // 64 AS frame_no, sample_no % 64 // 4 AS slot, sample_no % 4 AS pos, x FROM samples),
    e AS (SELECT element_id, channel, frame_no, slot, sum(x * x) AS e FROM s GROUP BY ALL),
    t AS (SELECT element_id, channel, frame_no, slot, max(e) OVER f * count(*) OVER f / sum(e) OVER f AS strength, row_number() OVER (PARTITION BY element_id, channel, frame_no ORDER BY e DESC, slot) AS k
          FROM e WINDOW f AS (PARTITION BY element_id, channel, frame_no)),
    v AS (SELECT *, row_number() OVER (PARTITION BY element_id, frame_no ORDER BY strength DESC, channel) AS n FROM t WHERE k = 1 AND channel <> 3),
    g AS (SELECT element_id, frame_no, coalesce(strength, 0) AS strength, coalesce(slot, 0) AS slot, CASE WHEN strength > 4 THEN 2 ELSE 1 END AS envelopes,
                 CASE WHEN strength > 4 THEN 2 * greatest(0, least(3, trunc((slot - 2) / 2)::INT)) + 2 ELSE 16 END AS border
          FROM (SELECT DISTINCT element_id, frame_no FROM e) LEFT JOIN (SELECT * FROM v WHERE n = 1) USING (element_id, frame_no))"""

ORACLE = {
    "spanned_decisions": f"SELECT stream_id, frame_no, wish, block_type FROM ({FRAME_ORACLE['block_decisions']})",
    "spanned_half_rate": FRAME_ORACLE["half_rate"],
    "stream_chunks": """WITH f AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, hex(encode(event_type)) AS h, length(event_type) + 7 AS n FROM events),
        w AS (SELECT *, frame_no // 16 AS chunk_no, printf('FFF15080%02X%02XFC', n // 8, n % 8 * 32 + 31) || h AS w, sum(n) OVER (PARTITION BY stream_id ORDER BY frame_no) - n AS b FROM f)
        SELECT stream_id, chunk_no, min(b)::BIGINT AS "offset", sum(n)::BIGINT AS bytes, md5(unhex(string_agg(w, '' ORDER BY frame_no))) AS digest FROM w GROUP BY 1, 2""",
    "element_grids": f"WITH {GRID_SQL} SELECT element_id, frame_no, round(strength, 6) AS strength, slot, envelopes, border FROM g",
    "slot_envelopes": f"""WITH {GRID_SQL}, e2 AS (SELECT element_id, frame_no, border, unnest(range(envelopes)) AS envelope FROM g)
        SELECT element_id, frame_no, envelope, greatest(1, len([i for i in range(0, 16, 2) if (i >= border)::INT = envelope])) AS sampled FROM e2""",
    "envelope_energies": f"""WITH {GRID_SQL}, x AS (SELECT element_id, channel, frame_no, slot, {", ".join(f"sum(CASE WHEN pos = {i} THEN x ELSE 0 END) AS x{i}" for i in range(4))} FROM s WHERE channel <> 3 AND slot % 2 = 0 GROUP BY ALL),
        b AS (SELECT *, unnest([0, 1, 2, 3]) AS band, unnest([((x0 + x1 + x2 + x3) / 2) ** 2, ((x0 + x1 - x2 - x3) / 2) ** 2, ((x0 - x1 - x2 + x3) / 2) ** 2, ((x0 - x1 + x2 - x3) / 2) ** 2]) AS w FROM x)
        SELECT element_id, frame_no, channel, (b.slot >= border)::INT AS envelope, band, round(sum(w) / 1e6, 3) AS energy FROM b JOIN g USING (element_id, frame_no) GROUP BY ALL""",
    "common_windows": f"""WITH b AS ({FRAME_ORACLE["block_decisions"]}),
        n AS (SELECT stream_id, sub_no // 8 AS frame_no, 1 + count(*) FILTER (WHERE attack AND sub_no % 8 > 0) AS n FROM (WITH {HE_SQL} SELECT * FROM attacked) GROUP BY ALL),
        f AS (SELECT stream_id, frame_no, block_type, CASE WHEN block_type = 2 THEN n ELSE 1 END AS groups FROM b JOIN n USING (stream_id, frame_no))
        SELECT l.stream_id // 2 AS pair_no, l.frame_no, l.block_type = r.block_type AND l.groups = r.groups AS common FROM f l JOIN f r ON r.stream_id = l.stream_id + 1 AND r.frame_no = l.frame_no WHERE l.stream_id % 2 = 0""",
    "uneven_peak_rate": f"""WITH RECURSIVE {SIZES_SQL}, d AS (SELECT *, CASE WHEN frame_no % 5 = 3 THEN 960 WHEN frame_no < 2 THEN 900 ELSE 1024 END AS duration FROM sizes),
        k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_no) AS k FROM (SELECT *, max(duration) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS longest FROM d) WHERE duration = longest),
        fold AS (SELECT stream_id, 0::BIGINT AS k, 0::BIGINT AS size, 0::BIGINT AS lasts, 0::BIGINT AS most FROM (SELECT DISTINCT stream_id FROM sizes)
            UNION ALL SELECT stream_id, k, CASE WHEN l >= 8000 THEN 0 ELSE s END, CASE WHEN l >= 8000 THEN 0 ELSE l END, CASE WHEN l >= 8000 THEN greatest(most, s * 64000 // l) ELSE most END
            FROM (SELECT fold.stream_id, k.k, fold.size + k.size AS s, fold.lasts + k.duration AS l, fold.most FROM fold JOIN k ON k.stream_id = fold.stream_id AND k.k = fold.k + 1))
        SELECT stream_id, max(most) AS peak_rate FROM fold GROUP BY 1""",
    "shared_groups": FRAME_ORACLE["window_groups"]
    .replace("SELECT vec_id AS frame_no, w,", "SELECT pair_no AS frame_no, w,")
    .replace("embedding[w * 8 + b * 2 + 1]::DOUBLE * 1000) ** 2", "l[w * 8 + b * 2 + 1]::DOUBLE * 1000) ** 2 + (r[w * 8 + b * 2 + 1]::DOUBLE * 1000) ** 2")
    .replace("embedding[w * 8 + b * 2 + 2]::DOUBLE * 1000) ** 2", "l[w * 8 + b * 2 + 2]::DOUBLE * 1000) ** 2 + (r[w * 8 + b * 2 + 2]::DOUBLE * 1000) ** 2")
    .replace("FROM embeddings, range(8)", "FROM (SELECT a.vec_id // 2 AS pair_no, a.embedding AS l, b.embedding AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0), range(8)")
    .replace("SELECT frame_no, array_to_string", "SELECT frame_no AS pair_no, array_to_string"),
    "measured_bands": f"""WITH p AS (SELECT l.vec_id // 2 AS pair_no, l.embedding AS a, r.embedding AS b, CASE WHEN l.vec_id // 2 % 3 = 0 THEN 0.001 ELSE 1.0 END::DOUBLE AS f FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 AND l.vec_id % 2 = 0),
        x AS (SELECT pair_no, i - 1 AS line, a[i]::DOUBLE * 1000 * f AS l, b[i]::DOUBLE * 1000 * f AS r, (a[i]::DOUBLE * 1000 + b[i]::DOUBLE * 1000) / 2 * f AS m FROM p, range(1, 65) t(i)),
        s AS (SELECT pair_no, sfb, lo, hi, sum(m * m) AS e, max(m * m) AS peak, sum(l * l) AS el, sum(r * r) AS er
              FROM x JOIN (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(B.EDGES_64, B.EDGES_64[1:])))}) v(sfb, lo, hi) ON line >= lo AND line < hi GROUP BY ALL),
        c AS (SELECT *, (pair_no + sfb) % 2 = 0 AND el > 0 AND e >= 0.16 * (hi - lo) AS ms FROM s)
        SELECT pair_no, sfb, round(CASE WHEN lo >= 40 THEN 0 WHEN ms THEN least(el, er) / 2 ELSE e END, 2) AS energy, round(CASE WHEN lo >= 40 THEN 0 WHEN ms THEN peak * (least(el, er) / 2) / e ELSE peak END, 2) AS peak FROM c""",
    "option_status": """WITH p AS (SELECT o_orderkey AS stream_id, o_custkey % 6 + 1 AS channels, o_custkey % 7 = 3 AS no_control, o_orderkey % 9 = 4 AS no_output, o_orderkey % 7 = 6 AS no_input, o_orderkey % 13 = 0 AS used,
              CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 2 THEN range(1, o_custkey % 6 + 2) WHEN 3 THEN range(0, o_custkey % 6) ELSE range(0, o_custkey % 6 + 1) END AS map FROM orders)
        SELECT stream_id, CASE WHEN no_control OR no_output OR no_input OR used OR len(map) < channels OR len([x for x in map if x < 0 OR x >= channels]) > 0 THEN 'invalid' ELSE 'ok' END AS status FROM p""",
    "rate_layouts": f"""WITH layout(r, sfb, lo, hi) AS (VALUES {", ".join(map(str, C.band_layouts()))}), n AS (SELECT r, count(*) AS n_bands, max(lo) AS last_start FROM layout GROUP BY r),
        q(r, low, high) AS (VALUES {", ".join(str((i, *r)) for i, r in enumerate(PREDICTED_BANDS))})
        SELECT stream_id, n_bands, last_start, least(low, n_bands) AS first_band, least(high, n_bands) AS past_band FROM ({PARAMS_SQL}) p JOIN n ON n.r = p.stream_id % 12 JOIN q ON q.r = n.r""",
    "tag_texts": r"""WITH t AS (SELECT doc_id, text, length(regexp_extract(text, '^[\x00-\x7F]*', 0)) AS p, hex(encode(text)) AS h FROM documents),
        c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN substr(h, 2 * p + 3) ELSE h END AS h, CASE WHEN doc_id % 2 = 1 THEN substr(text, p + 2) ELSE text END AS rest FROM t),
        v AS (SELECT *, regexp_full_match(h, '([0-7][0-9A-F]|[CD][0-9A-F][89AB][0-9A-F]|E[0-9A-F]([89AB][0-9A-F]){2}|F[0-7]([89AB][0-9A-F]){3})*') AS valid FROM c)
        SELECT doc_id, valid, CASE WHEN valid THEN length(rest) ELSE length(h) // 2 END AS n_chars, CASE WHEN h = '' THEN 0 WHEN valid THEN unicode(rest) ELSE ('0x' || substr(h, 1, 2))::BIGINT END AS first_char FROM v""",
}
