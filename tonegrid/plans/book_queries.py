"""Queries on code lengths, books and packed bits, over spectra and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as X
from ..operators import bands as B
from ..operators import books as K
from ..operators import frames as W
from ..operators.packing import packed
from ..sources.signals import spectra, table
from .band_queries import SPEC_SQL

#: Gains that quantize the spectra from coarse to fine, by frame; the header of a long block's section; the band from which
#: bands count for a shape's second book.
GAINS, HEADER, UPPER = (0.05, 0.005, 0.001, 0.2), 9, 5
KEYS, N_BANDS = ["frame_no", "sfb"], len(B.EDGES_64) - 1


def values(spark: SparkSession, sf: str) -> DataFrame:
    """frame_no, sfb and q: the quantized values of each band."""
    gain = F.element_at(F.array(*[F.lit(g) for g in GAINS]), (F.col("frame_no") % len(GAINS) + 1).cast("int"))
    own = spectra(spark, sf).withColumn("gain", gain).withColumn("q", F.transform("spec", lambda x: B.quantized(x, F.col("gain"))))
    cut = F.transform(B.band_list(B.EDGES_64), lambda b: F.struct(b.sfb.alias("sfb"), F.slice("q", b.lo + 1, b.hi - b.lo).alias("q")))
    return own.select("frame_no", F.explode(cut).alias("b")).select("frame_no", "b.sfb", "b.q")


def lengths(codes: DataFrame) -> DataFrame:
    return K.code_lengths(codes, F.col("sfb") >= UPPER)


def book_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Code lengths and words of every index of every book, from the values' own counts."""
    return K.codewords(lengths(K.band_codes(values(spark, sf), KEYS)))


def book_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of each band in every book it may use."""
    codes = K.band_codes(values(spark, sf), KEYS)
    return K.book_bits(codes, lengths(codes), KEYS)


def chosen(frames: DataFrame, codes: DataFrame, table: DataFrame) -> DataFrame:
    """frame_no, bits and books: what the search finds for each frame."""
    costs = K.cost_arrays(frames, K.book_bits(codes, table, KEYS), "frame_no", N_BANDS)
    return costs.select("frame_no", K.cheapest_books(F.col("costs"), HEADER).alias("found")).select("frame_no", "found.*")


def chosen_books(spark: SparkSession, sf: str) -> DataFrame:
    """The books of each frame's bands that take the least bits together with their sections."""
    codes = K.band_codes(values(spark, sf), KEYS)
    return chosen(spectra(spark, sf), codes, lengths(codes)).select("frame_no", "bits", F.array_join(F.col("books").cast("array<string>"), ",").alias("books"))


def chosen_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The sections that the chosen books make: runs of equal books, and their bits."""
    codes = K.band_codes(values(spark, sf), KEYS)
    rows = chosen(spectra(spark, sf), codes, lengths(codes)).select(F.col("frame_no").alias("stream_id"), F.posexplode("books").alias("band", "book"))
    found = W.runs(rows, "book", "band")
    return found.groupBy(F.col("stream_id").alias("frame_no")).agg(F.count(F.lit(1)).alias("sections"), F.sum(X.section_bits(F.col("n"))).cast("long").alias("bits"))


def coded_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame's values in the chosen books, as bits: codewords, signs and escapes. Frames of zeros have none."""
    own = values(spark, sf)
    codes = K.band_codes(own, KEYS)
    table = lengths(codes)
    books = chosen(spectra(spark, sf), codes, table).select("frame_no", F.posexplode("books").alias("sfb", "book"))
    fields = K.book_fields(codes, books, K.codewords(table), "frame_no", own)
    order = W.Window.partitionBy("frame_no").orderBy("at")
    numbered = fields.select(F.col("frame_no").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_no"), "value", "width")
    return packed(numbered).select(F.col("stream_id").alias("frame_no"), "n_bits", "hex")


def packed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's event ids, scrambled, as fields of 1 to 32 bits, in chunks of 4 words."""
    w = W.Window.partitionBy("user_id").orderBy("event_id")
    fields = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_no"), (F.col("event_id") * 2654435761).alias("value"), (F.col("event_id") % 32 + 1).cast("int").alias("width"))
    return packed(fields, span=8, chunk_words=4)


QUERIES = {f.__name__: f for f in (book_lengths, book_costs, chosen_books, chosen_sections, coded_spectra, packed_fields)}

HEX_SQL = "array_to_string([substr('0123456789ABCDEF', list_position(['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'], substr(s, 4 * i + 1, 4)), 1) for i in range(length(s) // 4)], '')"
CODES_SQL = f"""{SPEC_SQL}, layout(sfb, lo, hi) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(B.EDGES_64, B.EDGES_64[1:])))}),
    books(book, n, largest, signed, radix) AS (VALUES {", ".join(f"({b}, {n}, {largest}, {signed}, {K.radix(b)})" for b, (n, largest, signed) in K.BOOKS.items())}),
    v AS (SELECT frame_no, sfb, i, (sign(x) * floor(pow(abs(x) * ({list(GAINS)}::DOUBLE[])[frame_no % {len(GAINS)} + 1], 0.75) + 0.4054::DOUBLE))::INT AS v FROM spec JOIN layout ON i >= lo AND i < hi),
    vals AS (SELECT frame_no, sfb, list(v ORDER BY i) AS q, max(abs(v)) AS most FROM v GROUP BY 1, 2),
    spread AS (SELECT frame_no, sfb, b.*, unnest(range(len(q) // n)) AS place, q FROM vals JOIN books b ON most > 0 AND (book = {K.ESCAPE} OR most <= largest)),
    tuples AS (SELECT * EXCLUDE (q), q[place * n + 1:place * n + n] AS t FROM spread),
    codes AS (SELECT *, list_reduce([CASE WHEN signed THEN v + largest ELSE least(abs(v), largest) END for v in t], lambda s, x: s * radix + x) AS code,
                     CASE WHEN signed THEN 0 ELSE len([v for v in t if v <> 0]) END + CASE WHEN book = {K.ESCAPE} THEN coalesce(list_sum([2 * (length(ltrim(bin(abs(v)), '0')) - 1) - 3 for v in t if abs(v) >= 16]), 0) ELSE 0 END AS extra FROM tuples),
    used AS (SELECT book, code, count(*) AS n FROM codes WHERE book = {K.ESCAPE} OR (sfb >= {UPPER}) = (book % 2 = 0) GROUP BY 1, 2),
    symbols AS (SELECT book, list({{'w': (coalesce(u.n, 0) + 1)::BIGINT, 'code': e.code}} ORDER BY coalesce(u.n, 0), e.code) AS symbols FROM (SELECT book, unnest(range((radix ** n)::BIGINT)) AS code FROM books) e LEFT JOIN used u USING (book, code) GROUP BY book),
    leaves AS (SELECT book, [{{'w': s.w, 'leaf': 1}} for s in symbols] AS leaves FROM symbols),
    lists AS (SELECT book, 1 AS level, leaves, leaves AS items FROM leaves
        UNION ALL SELECT book, level + 1, leaves, list_sort(list_concat(leaves, [{{'w': items[2 * i + 1].w + items[2 * i + 2].w, 'leaf': 0}} for i in range(len(items) // 2)])) FROM lists WHERE level < {K.LONGEST}),
    down AS (SELECT book, {K.LONGEST + 1} AS level, (2 * len(leaves) - 2)::BIGINT AS take, -1::BIGINT AS m FROM leaves
        UNION ALL SELECT book, level, 2 * (take - m), m FROM (SELECT d.book, l.level, d.take, len([x for x in l.items[1:d.take] if x.leaf = 1]) AS m FROM down d JOIN lists l ON l.book = d.book AND l.level = d.level - 1)),
    taken AS (SELECT book, list(m) AS ms FROM down WHERE m >= 0 GROUP BY book),
    lengths AS (SELECT book, symbols[i + 1].code::INT AS code, len([m for m in ms if m > i])::INT AS length FROM (SELECT book, symbols, unnest(range(len(symbols))) AS i FROM symbols) JOIN taken USING (book)),
    words AS (SELECT *, (coalesce(sum(1::BIGINT << ({K.LONGEST} - length)) OVER (PARTITION BY book ORDER BY length, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> ({K.LONGEST} - length)) AS word FROM lengths),
    costs AS (SELECT frame_no, sfb, book, sum(length + extra)::INT AS bits FROM codes JOIN lengths USING (book, code) GROUP BY 1, 2, 3)"""
PATH_SQL = f"""{CODES_SQL}, by_book AS (SELECT frame_no, sfb, map(list(book), list(bits)) AS m FROM costs GROUP BY 1, 2),
    c AS (SELECT v.frame_no, v.sfb, CASE WHEN m IS NULL THEN list_concat([0], [NULL::INT for k in range({K.ESCAPE})]) ELSE [m[k] for k in range({K.N_STATES})] END AS c FROM vals v LEFT JOIN by_book USING (frame_no, sfb)),
    dp AS (SELECT frame_no, -1 AS sfb, [NULL::INT for k in range({K.N_STATES})] AS dp, []::INT[] AS back FROM (SELECT DISTINCT frame_no FROM vals)
        UNION ALL SELECT d.frame_no, c.sfb, [c[k] + CASE WHEN dp[k] IS NOT NULL AND dp[k] <= coalesce(list_min(dp), 0) + {HEADER} THEN dp[k] ELSE coalesce(list_min(dp), 0) + {HEADER} END for k in range(1, {K.N_STATES + 1})],
            [CASE WHEN dp[k] IS NOT NULL AND dp[k] <= coalesce(list_min(dp), 0) + {HEADER} THEN k - 1 ELSE coalesce(list_position(dp, list_min(dp)) - 1, 0) END::INT for k in range(1, {K.N_STATES + 1})] FROM dp d JOIN c ON c.frame_no = d.frame_no AND c.sfb = d.sfb + 1),
    path AS (SELECT frame_no, sfb, (list_position(dp, list_min(dp)) - 1)::INT AS book FROM dp WHERE sfb = {N_BANDS - 1}
        UNION ALL SELECT p.frame_no, p.sfb - 1, d.back[p.book + 1] FROM path p JOIN dp d ON d.frame_no = p.frame_no AND d.sfb = p.sfb WHERE p.sfb > 0)"""

ORACLE = {
    "book_lengths": f"WITH RECURSIVE {CODES_SQL} SELECT * FROM words",
    "book_costs": f"WITH RECURSIVE {CODES_SQL} SELECT * FROM costs",
    "chosen_books": f"""WITH RECURSIVE {PATH_SQL}, least AS (SELECT frame_no, list_min(dp) AS bits FROM dp WHERE sfb = {N_BANDS - 1})
        SELECT frame_no, bits, string_agg(book, ',' ORDER BY sfb) AS books FROM path JOIN least USING (frame_no) GROUP BY 1, 2""",
    "chosen_sections": f"""WITH RECURSIVE {PATH_SQL}, islands AS (SELECT frame_no, book, sfb - row_number() OVER (PARTITION BY frame_no, book ORDER BY sfb) AS island FROM path),
        found AS (SELECT frame_no, count(*) AS n FROM islands GROUP BY frame_no, book, island)
        SELECT frame_no, count(*) AS sections, sum(4 + 5 * (n // 31 + 1))::BIGINT AS bits FROM found GROUP BY 1""",
    "coded_spectra": f"""WITH RECURSIVE {PATH_SQL}, parts AS (SELECT frame_no, sfb, place, lpad(bin(word), length, '0') || CASE WHEN signed THEN '' ELSE array_to_string([CASE WHEN v < 0 THEN '1' ELSE '0' END for v in t if v <> 0], '') END
            || CASE WHEN book = {K.ESCAPE} THEN array_to_string([repeat('1', length(ltrim(bin(abs(v)), '0')) - 5) || '0' || substr(ltrim(bin(abs(v)), '0'), 2) for v in t if abs(v) >= 16], '') ELSE '' END AS s
            FROM codes JOIN path USING (frame_no, sfb, book) JOIN words USING (book, code)),
        texts AS (SELECT frame_no, string_agg(s, '' ORDER BY sfb, place) AS s FROM parts GROUP BY 1), padded AS (SELECT frame_no, length(s) AS n_bits, s || repeat('0', (8 - length(s) % 8) % 8) AS s FROM texts)
        SELECT frame_no, n_bits, {HEX_SQL} AS hex FROM padded""",
    "packed_fields": f"""WITH f AS (SELECT user_id AS stream_id, event_id, right(repeat('0', 32) || bin(event_id * 2654435761), (event_id % 32 + 1)::INT) AS s FROM events),
        t AS (SELECT stream_id, string_agg(s, '' ORDER BY event_id) AS s FROM f GROUP BY 1), c AS (SELECT stream_id, unnest(range((length(s) + 127) // 128)) AS chunk_no, s FROM t),
        p AS (SELECT stream_id, chunk_no, substr(s, 128 * chunk_no + 1, 128) AS s FROM c), padded AS (SELECT stream_id, chunk_no, length(s) AS n_bits, s || repeat('0', (8 - length(s) % 8) % 8) AS s FROM p)
        SELECT stream_id, chunk_no, n_bits, {HEX_SQL} AS hex FROM padded""",
}
