"""Top-k search, resampling and alignment of tokenizers against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tonegrid.llm.resample import Dictionary, Shifts, resample
from tonegrid.llm.token_align import Aligner, ByteLevel, Fragment, PieceModel, Tokens, alignment_report, spans
from tonegrid.llm.top_k import top_k


def brute_top_k(rows, asks, k, scale):
    """query id, rank, vec_id, score, by Python's integers."""
    used = []
    for i, x in rows:
        if x is not None and all(c is not None and math.isfinite(c * scale) for c in x):
            used.append((i, [math.floor(c * scale) for c in x]))
    out = []
    for a, (q, x) in enumerate(used):
        if q is None or not asks(q):
            continue
        scored = [(-max(min(sum(s * t for s, t in zip(x, y)), 2**63 - 1), -(2**63)), v is None, v or 0, v) for b, (v, y) in enumerate(used) if b != a]
        out += [(q, r + 1, v, -s) for r, (s, _, _, v) in enumerate(sorted(scored, key=lambda t: t[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, rows, k=3, scale=64.0, **how):
    df = spark.createDataFrame([(i, x, "r", 1.0) for i, x in rows], "vec_id long, embedding array<double>, row string, score double")
    got = top_k(df, F.col("vec_id") % 5 == 0, k=k, scale=scale, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("groups,block_rows", [(1, 1000), (2, 7), (4, 16), (9, 50)])
def test_top_k(spark, groups, block_rows):
    rng = np.random.default_rng(groups)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(200 + i, [0.5] * 6) for i in range(40)] + [(3, rng.normal(size=6).tolist())]
    assert searched(spark, rows, groups=groups, block_rows=block_rows) == brute_top_k(rows, lambda q: q % 5 == 0, 3, 64.0)


def test_top_k_of_odd_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [float("nan"), 1.0]), (20, [inf, 1.0]), (25, []), (30, [1.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (35, [-0.001, 0.0]), (40, [-1e300, 2.0])]
    for block_rows in (2, 100):
        assert searched(spark, rows, k=4, block_rows=block_rows) == brute_top_k(rows, lambda q: q % 5 == 0, 4, 64.0)
    fewer = [r for r in rows if r[0] != 40]
    assert searched(spark, fewer, k=50) == brute_top_k(fewer, lambda q: q % 5 == 0, 50, 64.0)
    large = [(i, [float(3 * i * 10**k) for k in (4, 6, 8)]) for i in range(12)]
    assert searched(spark, large, k=3, block_rows=5) == brute_top_k(large, lambda q: q % 5 == 0, 3, 64.0)
    assert searched(spark, []) == [] and searched(spark, [(5, [1.0])]) == [] and searched(spark, [(1, [1.0])]) == []


def brute_resample(docs, target, percent, least, buckets, order, seed):
    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(text):
        ws = words(text)
        return [zlib.crc32(" ".join(ws[i : i + m]).encode()) % buckets for m in range(1, order + 1) for i in range(len(ws) - m + 1)]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in docs], target))
    S, T = s.total(), t.total()
    rows = []
    for i, text in docs:
        f = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f)
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("order,percent", [(1, 10), (2, 50), (3, 100)])
def test_resample(spark, order, percent):
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    odd = [None, "", " \t--", "A", "Ünï CÖDÉ 你好 x1y2 [a]^b_`c\x7fd\x00e", "İI ſ K", "the The THE " * 3000, "w" * 5000 + " z", "😀 a b"]
    docs = list(enumerate(some + odd)) + [(None, "a b c " * 10), (3, some[3]), (3, some[3])]
    target = [*some[:3], "the a b c", None, ""]
    frame = spark.createDataFrame([(i, x, 0.5, 1, "b") for i, x in docs], "doc_id long, text string, score double, rank int, bucket string").repartition(3)
    goal = spark.createDataFrame([(x, 2) for x in target], "text string, n int")
    got = resample(frame, goal, percent=percent, least_words=5, buckets=500, order=order, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, target, percent, 5, 500, order, 7)
    assert resample(frame.limit(0), goal).count() == 0
    assert {r.weight for r in resample(frame, goal.limit(0), order=order).collect()} != set()


def test_dictionary_changes_nothing():
    """Features are the same while the dictionary is empty, learns, and is full."""
    rng = np.random.default_rng(1)
    own = [Dictionary(m) for m in (0, 50, 100_000)]
    for turn in range(30):
        texts = [" ".join(f"w{int(x)}é" for x in rng.zipf(1.3, 200) % 5000).encode() for _ in range(20)] + [None, b"", b"--"]
        expected = sorted(zlib.crc32(" ".join(ws[i : i + m]).encode()) for ws in ((t or b"").decode().split() for t in texts) if ws != ["--"] for m in (1, 2) for i in range(len(ws) - m + 1))
        for d in own:
            assert sorted(d.features(texts, 2)[0].tolist()) == expected
    assert own[0].automaton is None and len(own[1].ids) == 50 and len(own[2].ids) > 1000
    shift = Shifts()
    a, b = b"left part", b"0123456789" * 70_001
    assert (shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b)))[0] == zlib.crc32(a + b)


@pytest.fixture(scope="module")
def tokenizers():
    from tonegrid.llm.queries import TOKENIZERS

    return ByteLevel.load(f"{TOKENIZERS}/byte_bpe_50k.json", public_tokenizers.PATTERN), PieceModel.load(f"{TOKENIZERS}/piece_bpe_32k.model")


def brute_alignment(docs, tokenizers):
    """Rows of the report, with the libraries' tokens and all pairs of them."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from tonegrid.llm.queries import TOKENIZERS

    first, second = tokenizers
    lib_a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    lib_a.encode_special_tokens = True
    lib_b = SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    text_of = {i: t for t, i in first.ids.items()}
    rows, held = [], Counter()
    for i, text in docs:
        a = lib_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = lib_b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(text_of[x] for x in a) != whole or b"".join(second.vocabulary.texts[x] for x in b) != whole:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(text_of[x]) for x in a]).tolist(), np.cumsum([len(second.vocabulary.texts[x]) for x in b]).tolist()
        groups, p, q = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            u, v = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[p:u], b[q:v]))
            p, q = u, v
        links = Counter((x, y) for s, e, x in zip([0, *ends_a], ends_a, a) for t, f, y in zip([0, *ends_b], ends_b, b) if s < f and t < e)
        held.update(links.keys())
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(((i, na, nb, ng, sum(links.values()), sum(m for k, m in links.items() if held[k] == most[k[0]]), sum(m * held[k] for k, m in links.items()), sha) for i, na, nb, ng, links, sha in rows), key=str)


ODD_TEXTS = [None, "", " ", "  two  spaces \n\t x", "a▁b", "<|endoftext|> <s></s>", "你好世界 — ünïcödé 😀👍🏽", "x" * 900, "\x00\x1f  z", "1234567 ''s 'll don't", "é" * 700 + " b", "ﷺﬁ Å"]


@pytest.mark.parametrize("span,frequent", [(1 << 17, 200_000), (60, 30), (1, 0)])
def test_alignment(spark, tokenizers, span, frequent):
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").limit(25).collect()]
    docs = list(enumerate(ODD_TEXTS + some)) + [(None, "the cat"), (7, some[0]), (7, some[0])]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, part int, span string").repartition(3)
    got = alignment_report(frame, *tokenizers, span=span, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_alignment(docs, tokenizers)
    assert alignment_report(frame.limit(0), *tokenizers, span=span).count() == 0


def test_fragments_compose_in_any_order(tokenizers):
    """Ranges of bytes anywhere, tokens of both sides across their borders, composed from either end and in a tree."""
    own, rng = Aligner(*tokenizers), np.random.default_rng(3)
    for text in [x for x in ODD_TEXTS if x and "▁" not in x] + ["Many unbelievably long-winded sentences, 123456 of them; naïve café. " * 6]:
        a, b = own.tokens([" " + text])[0]
        a, b = (Tokens(np.array(x), lengths[x]) for x, lengths in ((a, own.lengths_a), (b, own.lengths_b)))
        ends_a, ends_b = a.lengths.cumsum(), b.lengths.cumsum()
        want = own.whole(own.fragment(a, b, ends_a, ends_b))
        for _ in range(5):
            borders = [0, *sorted(rng.integers(0, ends_a[-1] + 1, 7)), ends_a[-1]]
            parts = []
            for lo, hi in zip(borders, borders[1:]):
                (a1, a2), (b1, b2) = (np.searchsorted(e, [lo, hi], side="right") for e in (ends_a, ends_b))
                parts.append(own.fragment(a[a1:a2], b[b1:b2], ends_a[a1:a2], ends_b[b1:b2]))
            tree = parts
            while len(tree) > 1:
                tree = [own.compose(*tree[i : i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
            left = right = Fragment()
            for x, y in zip(parts, reversed(parts)):
                left, right = own.compose(left, x), own.compose(y, right)
            for x in (tree[0], left, right):
                got = own.whole(x)
                assert (got.n, got.text, got.pairs.tolist(), got.times.tolist()) == (want.n, want.text, want.pairs.tolist(), want.times.tolist())


def test_spans_keep_tokens(tokenizers):
    own = Aligner(*tokenizers)
    text = "One two  three\n four 5 six-seven don't stop 你好 x▁ y " * 8
    text = text.replace("▁", "")
    whole = own.tokens([" " + text])[0]
    for most in (1, 10, 50):
        parts = spans(text, most)
        assert "".join(parts) == " " + text and len(parts) > 3
        got = [own.tokens([x])[0] for x in parts]
        assert tuple(sum((x[k] for x in got), []) for k in (0, 1)) == whole
