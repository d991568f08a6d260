"""Mixing, token counts, SentencePiece and the pipeline's stages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

import corpus_pipeline
from tonegrid.llm.exact_dedup import distinct_documents
from tonegrid.llm.pieces import Encoder, Vocabulary, decode, encode, encoding_report
from tonegrid.llm.queries import ORACLE, TOKENIZERS
from tonegrid.llm.source_mix import mix_sources, mixed_documents
from tonegrid.llm.token_counts import at_limits, length_histogram, quantiles, ranks, token_lengths

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, sid string").repartition(parts)


def words(n, seed=0):
    return " ".join(f"w{(seed + i) % 50}" for i in range(n))


MIX = [(i, words(20 + i % 90, i), f"s{i % 3}" if i % 7 else None, 0, "x") for i in range(400)] + [(1000, None, "s0", 0, ""), (1001, "", "tiny", 0, ""), (1002, words(3000), "s1", 0, ""), (1003, words(5), "zz", 0, ""), (5, words(25, 5), "s2", 0, ""), (None, "a b", "s1", 0, "")]


@pytest.mark.parametrize("rows", [MIX, [], [(1, None, None, 0, "")], [(1, "one", "a", 0, "")]])
def test_mix(spark, rows):
    got = [tuple(r) for r in mix_sources(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(tuple(r) for r in mix_sources(frame(spark, rows, 5)).collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((d, n) for d, n, *_ in got) == Counter((r[0], size(r[1])) for r in rows)
    assert all(0 <= taken <= 3 * n for _, n, _, _, taken in got)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:  # share, cap, share the excess again
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(w for o, w in weight.items() if o not in capped) for s in order}
        if not (over := {s for s in order if s not in capped and target[s] > 3 * sizes[s]}):
            break
        capped |= over
    by_id = {r[0]: r[2] for r in rows if r[0] != 5}
    taken = defaultdict(int)
    for d, _, source_size, t, n in got:
        if d in by_id:
            assert source_size == sizes[by_id[d]] and t == pytest.approx(target[by_id[d]])
        taken[round(t, 6)] += n
    for t in taken:  # sources of one target are summed
        assert taken[t] == pytest.approx(sum(int(x + 0.5) for x in target.values() if round(x, 6) == t), abs=1)


def test_mix_fills_every_quota(spark):
    """300 sources of 16 words and more beside two big ones, in few blocks: each takes its target, rounded."""
    rows = [(i, words(16 + i % 5, i), f"s{i:03}", 0, "") for i in range(300)] + [(1000 + i, words(300, i), "abc"[i % 2] + "big", 0, "") for i in range(400)]
    got, by_target = mix_sources(frame(spark, rows), grain=256).groupBy("target", "source_size").sum("taken").collect(), 0
    of = Counter(16 + i % 5 for i in range(300))
    for t, size, n in got:
        assert n % int(t + 0.5) == 0 and n // int(t + 0.5) <= of.get(size, 1)
        by_target += n // int(t + 0.5)
    assert by_target == 302


def test_mixed_documents_are_what_mix_takes(spark):
    docs = frame(spark, MIX)
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    n = lambda t: len((t or "").encode().split())
    made, want = Counter(), Counter()
    for r in got.collect():
        made[r.doc_id] += n(r.text)
    for r in mix_sources(docs).collect():
        want[r.doc_id] += r.taken
    assert made == Counter({d: k for d, k in want.items() if k})
    texts = {r[0]: r[1] for r in MIX if r[0] != 5}
    assert all(texts[r.doc_id].startswith(r.text) for r in got.collect() if r.doc_id in texts)


def test_token_counts(spark):
    merges = ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    rows = [(1, None), (2, ""), (3, "hello world <|endoftext|>"), (3, "hello world"), (4, "x" * 30_000), (None, "ä 你好")] + [(i, words(i)) for i in range(10, 90)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    want = [len(own.encode_ordinary(t or "")) for _, t in rows]
    lengths = token_lengths(docs, merges, public_tokenizers.PATTERN)
    assert Counter(r.n_tokens for r in lengths.collect()) == Counter(want)
    histogram = length_histogram(lengths, span=16)
    for r in histogram.collect():
        k, over = r.n_tokens, [n for n in want if n >= r.n_tokens]
        assert (r.n_docs, r.docs_at_most, r.docs_at_least, r.tokens_at_least, r.truncated_total) == (want.count(k), sum(n <= k for n in want), len(over), sum(over), sum(min(n, k) for n in want))
    assert {(r.context_limit, r.docs_over, r.truncated_total) for r in at_limits(histogram, [0, 10, 10**6]).collect()} == {(k, sum(n > k for n in want), sum(min(n, k) for n in want)) for k in (0, 10, 10**6)}
    assert {r.share: r.n_tokens for r in quantiles(histogram, [0.0, 0.5, 1.0]).collect()} == {s: sorted(want)[max(0, int(np.ceil(s * len(want))) - 1)] for s in (0.0, 0.5, 1.0)}
    assert length_histogram(lengths.limit(0)).count() == 0 and at_limits(length_histogram(lengths.limit(0)), [5]).first()["truncated_total"] == 0


BPE = Encoder(Vocabulary.load(MODEL))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aehnorst  ▁\n\tü€<0xA1>.", max_size=60)), max_size=5))
def test_bpe_ids_are_the_library_s(texts):
    texts = [t for t in texts if "\x00" not in t]
    got = BPE.encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [LIBRARY.encode(t) for t in texts]
    assert all(BPE.decode(x) == t.replace("▁", " ").encode() for x, t in zip(got, texts))


def test_unigram_ids_are_the_library_s(tmp_path):
    """The same pieces as a unigram model with scores of their own."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    r = random.Random(5)
    for p in model.pieces:
        if p.type == 1:
            p.score = -2.0 - r.random() * 8 - 0.3 / len(p.piece)
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model")), Encoder(Vocabulary.load(str(tmp_path / "u.model")))
    texts = [r2[0] for r2 in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()]
    got = own.encode([t.encode() for t in texts])
    score = lambda ids: sum(library.get_score(i) if i >= 259 else 0 for i in ids)
    for x, t in zip(got, texts):
        want = library.encode(t)
        assert x.tolist() == want or score(x.tolist()) == pytest.approx(score(want), abs=1e-3)


@pytest.mark.parametrize("kind", [1, 2])
def test_user_defined_pieces(tmp_path, kind):
    """Pieces that users defined, in unigram and BPE models: the ids are the library's."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = kind
    r = random.Random(3)
    for p in model.pieces:
        if p.type == 1 and kind == 1:
            p.score = -2.0 - len(p.piece) - r.random()
    defined = ["<sep>", "ab|c", "<sep><sep>", "th", "中"]
    model.pieces.extend(sentencepiece_model_pb2.ModelProto.SentencePiece(piece=x, score=0.0, type=4) for x in defined if x not in {p.piece for p in model.pieces})
    for p in model.pieces:
        p.type = 4 if p.piece in defined else p.type
    (tmp_path / "d.model").write_bytes(model.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "d.model")), Encoder(Vocabulary.load(str(tmp_path / "d.model")))
    letters = [*defined, " ", "the", "ab", "|c", "a", "sep", "<", ">", "other", "é", "  "]
    texts = ["".join(r.choices(letters, k=r.randrange(1, 30))) for _ in range(400)]
    got = [x.tolist() for x in own.encode([t.encode() for t in texts])]
    if kind == 2:
        assert got == [library.encode(t) for t in texts]
    else:  # equal sums are broken in another order
        taken = lambda ids: sorted(i for i in ids if library.id_to_piece(i) in defined)
        assert [*map(taken, got)] == [taken(library.encode(t)) for t in texts]
    assert [own.decode(np.array(x)) for x in got] == [t.encode() for t in texts]


def test_encode_and_decode(spark):
    rows = [(1, None, "a", 0, ""), (2, "", "a", 0, ""), (3, "  two  spaces ", None, 0, ""), (3, "  two  spaces ", None, 0, ""), (None, "𝄞 ▁", "b", 0, ""), (4, "long" * 20_000, "c", 0, ""), (5, "a\nb " * 5000, "c", 0, "")]
    vocabulary = Vocabulary.load(MODEL)
    encoded = encode(frame(spark, rows), vocabulary, keep=["doc_id", "size"])
    assert encoded.columns == ["doc_id", "size", "ids", "n_pieces"]
    back = Counter((r.doc_id, r.text) for r in decode(encoded, vocabulary).collect())
    assert back == Counter((d, (t or "").replace("▁", " ")) for d, t, *_ in rows)
    report = encoding_report(frame(spark, rows), vocabulary).collect()
    for r in report:
        assert r.round_trip == (r.doc_id is not None)
        if r.doc_id == 4:
            assert r.n_pieces == len(LIBRARY.encode("long" * 20_000)) and r.decoded_sha256 == hashlib.sha256(b"long" * 20_000).hexdigest()
    assert encode(frame(spark, []), vocabulary).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        kept[name] = docs.toPandas()
        if name != "pieces":
            assert docs.columns == columns
            docs = spark.createDataFrame(kept[name], docs.schema)
        else:
            assert [list(x) for x in kept[name]["ids"]] == [LIBRARY.encode(t) for t in before.toPandas()["text"]]
        if name == "exact_dedup":
            assert sorted(kept[name]["text"]) == sorted(set(before.toPandas()["text"]))
    assert set(kept["near_dedup"]["doc_id"]) <= set(kept["exact_dedup"]["doc_id"])
    run = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(run["doc_id"], run["n_pieces"])) == sorted(zip(kept["pieces"]["doc_id"], kept["pieces"]["n_pieces"]))


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and near copies without a doc_id or a lang; and a table without rows."""
    clean = corpus_pipeline.quality_rules_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    own = [r.text for r in clean.where("lang = 'en' and n_chars between 900 and 2500").orderBy("doc_id").limit(3).collect()]
    near = own[0] + " And so on."
    rows = [(1, own[0], "en", "a"), (1, own[0], "en", "a"), (2, near, "en", None), (None, own[1], "en", "a"), (None, own[1], None, "a"), (3, own[2], None, "b"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t", "en", "b"), (7, "too short", None, "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame([(*r, len(r[1] or "")) for r in some], schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert got.columns == ["doc_id", "lang", "source", "ids", "n_pieces"]
        texts = {BPE.decode(np.array(r.ids)).decode() for r in got.collect()}
        assert {own.index(next(o for o in own if o.startswith(t))) for t in texts} == ({0, 1, 2} if some else set())


def test_oracles_on_the_smallest_tables(spark):
    """The queries with SQL, here on sf0.001; whole numbers, strings and flags must be equal."""
    from tonegrid.llm.queries import QUERIES

    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF)
        columns = sorted(got.columns)
        want = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        rounded = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
        assert rounded(map(tuple, got.select(*columns).collect())) == rounded(want), name
    assert distinct_documents(spark.read.parquet(f"{SF}/documents.parquet")).count() == db.sql("SELECT count(DISTINCT text) FROM documents").fetchall()[0][0]


def test_encoders_are_told_apart_by_content(spark):
    """Two vocabularies of one size in one session."""
    one, other = {bytes([i]): i for i in range(256)} | {b"ab": 256}, {bytes([i]): i for i in range(256)} | {b"cd": 256}
    docs = spark.createDataFrame([(1, "abab"), (2, "cdcd")], "doc_id long, text string").coalesce(1)
    got = [{r.doc_id: r.n_tokens for r in token_lengths(docs, m, r"\S+|\s+").collect()} for m in (one, other)]
    assert got == [{1: 2, 2: 4}, {1: 4, 2: 2}]


def test_token_query_on_the_smallest_tables(spark):
    from tonegrid.llm.queries import QUERIES

    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
    want = np.array(sorted(len(own.encode_ordinary(t or "")) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()))
    got = QUERIES["op8_token_counts"](spark, SF).collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(want.tolist()))
    for r in got:
        k = r.n_tokens
        assert (r.n_docs, r.docs_at_most, r.docs_at_least, r.tokens_at_least, r.truncated_total) == ((want == k).sum(), (want <= k).sum(), (want >= k).sum(), want[want >= k].sum(), np.minimum(want, k).sum())
