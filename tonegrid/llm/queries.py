"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_quality, language_id
from .common import documents
from .exact_dedup import exact_dedup
from .line_dedup import clean_lines
from .near_dedup import near_dedup
from .pieces import Vocabulary, encoding_report
from .quality_rules import quality_rules
from .resample import resample
from .source_mix import GOLDEN, mix_sources
from .token_align import ByteLevel, PieceModel, alignment_report
from .token_counts import length_histogram, ranks, token_lengths
from .top_k import top_k
from .url_filter import LIMIT, filter_urls, vocabulary

#: Where the public tokenizers' vocabulary files are.
TOKENIZERS = "/opt/tokenizers"
#: Allow and block rules of the url query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), weights=(5, 2, 1), epochs=3)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = compression_quality.fold(F.col("doc_id"), 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held).select("doc_id", F.col("quality").alias("label"))
    scored = compression_quality.score_quality(docs, compression_quality.fit(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = compression_quality.fold(F.col("doc_id"), 5) == 0
    found = language_id.predict(docs, language_id.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), percent=85, width=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(documents(spark, sf_dir), ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(documents(spark, sf_dir), Vocabulary.load(f"{TOKENIZERS}/piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10, least_words=20, buckets=10_000, order=1, seed=2024)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = ByteLevel.load(f"{TOKENIZERS}/byte_bpe_50k.json", public_tokenizers.PATTERN), PieceModel.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    return alignment_report(documents(spark, sf_dir), first, second)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, scale=64)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_mix_sources": op3_mix_sources,
    "op4_line_dedup": op4_line_dedup,
    "op5_compression_quality": op5_compression_quality,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_pieces": op9_pieces,
    "op10_quality_rules": op10_quality_rules,
    "op11_resample": op11_resample,
    "op12_token_align": op12_token_align,
    "op13_top_k": op13_top_k,
}

ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op7_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]
                                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
            FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), links AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
            WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN least c USING (doc_id)""",
    "op3_mix_sources": rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id) AS h FROM documents
        ), s0 AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
        ), s1 AS (
            SELECT *, [5.0::DOUBLE, 2.0, 1.0][sid % 3 + 1] AS weight FROM s0
        ), s2 AS (
            SELECT *, source_size / weight AS ratio,
                   (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
            FROM s1 WINDOW w AS (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), s3 AS (
            SELECT *, least(3.0 * source_size, (SELECT level FROM s2 WHERE level * weight <= 3 * source_size ORDER BY ratio, sid LIMIT 1) * weight) AS target,
                   greatest(ceil(source_size / greatest(1.0, (SELECT sum(source_size) FROM s2) / 65536)), least(source_size, 16))::BIGINT AS n
            FROM s2
        ), s AS (
            SELECT *, coalesce(sum(quota) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
                   floor(target + 0.5)::BIGINT - ((quota - 1) * source_size + n - 1) // greatest(n, 1) AS rest
            FROM (SELECT *, CASE WHEN n > 0 THEN (floor(target + 0.5)::BIGINT * n + source_size - 1) // source_size ELSE 0 END::BIGINT AS quota FROM s3)
        ), t AS (
            SELECT sum(quota)::BIGINT AS total FROM s
        ), slots AS (
            SELECT k, ((k + 0.5::DOUBLE) * {GOLDEN!r}::DOUBLE % 1) * total AS x FROM (SELECT total, unnest(range(2 * total)) AS k FROM t)
        ), reads AS (
            SELECT sid, rank % n AS block, count(*) FILTER (WHERE rank < quota - 1) AS times, coalesce(max(CASE WHEN rank = quota - 1 THEN rest END), 0) AS head
            FROM (SELECT s.*, row_number() OVER (PARTITION BY sid ORDER BY k) - 1 AS rank FROM slots JOIN s ON x >= low AND x < low + quota)
            WHERE rank < quota GROUP BY ALL
        ), placed AS (
            SELECT d.*, sid, n, source_size, target, nth, pos FROM (
                SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, size) AS nth, (sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM d
            ) d JOIN s ON d.source IS NOT DISTINCT FROM s.source
        ), taken AS (
            SELECT p.sid, nth, sum(times * greatest(0, least(pos + size, ((p.block + 1) * source_size + n - 1) // n) - greatest(pos, (p.block * source_size + n - 1) // n))
                                   + greatest(0, least(pos + size, (p.block * source_size + n - 1) // n + head) - greatest(pos, (p.block * source_size + n - 1) // n))) AS taken
            FROM (SELECT *, unnest(range(pos * n // source_size, (pos + size - 1) * n // source_size + 1)) AS block FROM placed WHERE size > 0) p
            JOIN reads r ON p.sid = r.sid AND p.block = r.block GROUP BY ALL
        )
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (sid, nth)""",
    "op2_url_filter": rf"""
        WITH parts AS (
            SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), hits AS (
            SELECT p.page_id, count(*) FILTER (WHERE weight >= {LIMIT}) AS n_strict, count(*) FILTER (WHERE weight < {LIMIT}) AS n_soft, sum(weight)::BIGINT AS weight
            FROM p JOIN (VALUES {", ".join(f"('{term}', {weight})" for term, weight in vocabulary().items())}) v(term, weight)
              ON contains(low, term) AND regexp_matches(low, '(^|[^\pL\pN])' || term || '($|[^\pL\pN])') GROUP BY p.page_id
        ), fits AS (
            SELECT p.page_id, arg_max(rule, len(rule)) AS rule, arg_max(said, len(rule)) AS said
            FROM p JOIN (VALUES {", ".join(f"('{said}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for said, rule in RULES)}) r(said, rule, h, q)
              ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY p.page_id
        )
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
               coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(weight, 0) AS weight
        FROM p LEFT JOIN hits USING (page_id) LEFT JOIN fits USING (page_id)""",
    "op4_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
        ), worded AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ), w AS (
            SELECT a.doc_id, a.k, [a.norm, b.norm, c.norm] AS win FROM worded a JOIN worded b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN worded c ON c.doc_id = a.doc_id AND c.k = a.k + 2
        ), marked AS (
            SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) = 1 AS is_first FROM w
        ), gone AS (
            SELECT doc_id, i FROM worded x
            WHERE EXISTS (SELECT 1 FROM marked m WHERE m.doc_id = x.doc_id AND x.k BETWEEN m.k AND m.k + 2 AND NOT is_first)
        ), kept AS (
            SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS clean FROM l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
        )
        SELECT d.doc_id, coalesce((SELECT count(*) FROM worded x WHERE x.doc_id = d.doc_id), 0) AS n_lines, coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS n_removed,
               sha256(coalesce(clean, '')) AS clean_sha256
        FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op11_resample": r"""
        WITH table_of AS (
            SELECT [list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) for b in range(256)] AS steps
        ), texts AS (
            SELECT false AS goal, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark
        ), worded AS (
            SELECT goal, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
        ), own AS (
            SELECT goal, r, unnest(ws) AS w FROM worded
        ), bytes AS (
            SELECT w, [('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT for i in range(octet_length(encode(w)))] AS bs FROM (SELECT DISTINCT w FROM own)
        ), hashed AS (
            SELECT w, xor(list_reduce(bs, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bytes, table_of
        ), counts AS (
            SELECT bucket, count(*) FILTER (WHERE NOT goal)::DOUBLE AS s, count(*) FILTER (WHERE goal)::DOUBLE AS t FROM own JOIN hashed USING (w) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM counts
        ), weights AS (
            SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM own JOIN hashed USING (w) JOIN gains USING (bucket) WHERE NOT goal GROUP BY r
        ), scores AS (
            SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM worded d LEFT JOIN weights USING (r) WHERE NOT goal
        ), ranked AS (
            SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scores
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM ranked""",
    "op13_top_k": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS r, [floor(64 * x::DOUBLE) for x in embedding] AS c FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), p AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.c, c.c)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p) WHERE rank <= 20""",
}
