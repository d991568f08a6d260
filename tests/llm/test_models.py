"""Held-out accuracy and odd cases of the url filter, both classifiers and the quality rules."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import compression_quality, language_id
from tonegrid.llm.quality_rules import N_CLASSES, accepted, class_table, jensen_shannon, quality_rules, references, repeated_words
from tonegrid.llm.queries import QUERIES, RULES
from tonegrid.llm.url_filter import filter_urls, vocabulary

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (4, "the word " * 20_000), (4, "the word " * 20_000), (5, "12 34 #$% 你好"), (6, "😀")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i != 5 else None, "s", 0.5, "u") for i, t in rows], "doc_id long, text string, lang string, source string, score double, url string")


def test_urls(spark):
    urls = [
        ("https://a.b.Example.NET/en/1?x=porn", "a.b.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://myexample.net?q", "myexample.net", "", None, "allow"), ("http://x.org/fr/porn", "x.org", "/fr/porn", "org/fr/", "allow"), ("http://x.org/porn.html", "x.org", "/porn.html", None, "block"),
        ("http://x.org/pornographic", "x.org", "/pornographic", None, "allow"), ("http://x.org/casino/poker", "x.org", "/casino/poker", None, "block"), ("http://x.org/casino/CASINO", "x.org", "/casino/CASINO", None, "allow"),
        ("no scheme casino", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://" + "a" * 50_000 + "#f", "a" * 50_000, "", None, "allow"), ("://net/", "net", "/", "net/", "block"),
    ]
    df = spark.createDataFrame([(i, u[0], "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert filter_urls(df.limit(0), RULES).count() == 0 and filter_urls(df, (), {}).where("verdict = 'block'").count() == 0


def test_url_terms_decide(spark):
    """Strict, soft and weak terms, repeats, boundaries in any alphabet; against a search with regular expressions."""
    import regex

    terms = vocabulary()
    assert len(terms) > 150 and {"porn": 5, "casino": 3, "free": 2}.items() <= terms.items()
    urls = {
        "http://a.com/porn": "block", "http://a.com/pornx": "allow", "http://a.com/éporn": "allow", "http://a.com/порporn": "allow", "http://a.com/porn你": "allow", "http://a.com/–porn–": "block",
        "http://casino.com/": "allow", "http://casino.com/poker": "block", "http://casino.com/CASINO/casino": "allow", "http://free-casino.com": "block", "http://free-casino2.com": "allow",
        "http://free.com/cheap": "allow", "http://free.com/cheap?win=1": "block", "PORN": "block", "http://a.com/9porn": "allow", "http://a.com/porn_": "block", "http://a.com/" + "x" * 30_000 + "/porn": "block",
    }
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(df, ()).collect()}
    for i, (url, verdict) in enumerate(urls.items()):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
        found = [w for t, w in terms.items() if regex.search(rf"(?<![\pL\pN]){t}(?![\pL\pN])", low)]
        assert (got[i].verdict, got[i].n_strict, got[i].n_soft, got[i].weight) == (verdict, sum(w >= 5 for w in found), sum(w < 5 for w in found), sum(found)), url


def test_quality_classifier_on_held_out_rows(spark):
    got = QUERIES["op5_compression_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93 and got["score"].between(0, 1).all()
    assert got[got["quality"] == 1]["predicted"].mean() > 0.97


def test_quality_classifier_odd_cases(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (99, 1), (None, 0)], "doc_id long, label int")
    for model in (compression_quality.fit(docs, labels), compression_quality.fit(docs, labels.where("label = 1")), compression_quality.fit(docs, labels.limit(0))):
        got = compression_quality.score_quality(docs, model)
        assert got.count() == len(ODD) and got.where("score between 0 and 1").count() == len(ODD)
    assert compression_quality.fit(docs, labels.limit(0)) == 0.5
    x = np.repeat([-1.0, 1.0], 50)
    slope, offset = compression_quality.logistic(x, np.r_[np.zeros(40), np.ones(10), np.zeros(10), np.ones(40)], np.ones(100))
    assert abs(1 / (1 + np.exp(-slope - offset)) - 0.8) < 0.01


def test_language_on_held_out_rows(spark):
    got = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_language_odd_cases(spark):
    docs = frame(spark, ODD)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got[4][0] == "en" and all(got[i] == ("und", 0.0) for i in (1, 2, 3, 6)) and got[5][0] == "en"
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"} and language_id.predict(docs.limit(0), nothing).count() == 0


def test_phrases_are_longest_matches():
    """Counts by automaton and blocks against a search for the longest match at each place of the whole text."""
    r = np.random.default_rng(3)
    ring = "abcdefg" * 20  # its blocks never agree with the parse that goes on
    refs = language_id.References({"a": "the cat sat on the mat and the dog", "b": "der hund und die katze", "c": ring})
    parser = language_id.Parser(refs)
    say = lambda n: " ".join(r.choice((refs.texts["a"] + " " + refs.texts["b"]).split(), n))
    texts = ["the cat and the hund", "zzz qqq", "und die mat", "a" * 2500 + " the dog", say(1200), "", ring * 40, say(900) + ring * 10 + say(400), "x" * 1024, say(300)[:1025]]
    got = parser.phrases([parser.symbols(t.encode()) for t in texts])
    for t, row in zip(texts, got):
        for name, n in zip(parser.names, row):
            at = want = 0
            while at < len(t):
                k = 1
                while at + k < len(t) and t[at : at + k + 1] in refs.texts[name]:
                    k += 1
                at, want = at + k, want + 1
            assert n == want


def test_every_letter_of_the_references_is_distinct():
    """Four languages with 1,500 letters each, of which no two share a word; blocks against the longest matches."""
    r = np.random.default_rng(5)
    pool = np.array([chr(c) for c in range(0x4E00, 0x4E00 + 3000)])
    vocabulary = {name: ["".join(r.choice(r.choice(pool, 1500, replace=False), 2)) for _ in range(150)] for name in "abcd"}
    say = lambda name, n: " ".join(r.choice(vocabulary[name], n))
    refs = language_id.References({**{name: say(name, 600) for name in "abcd"}, "latin": "the cat sat on the mat"})
    parser = language_id.Parser(refs)
    held = [(name, say(name, 40)) for name in "abcd" for _ in range(5)]
    texts = [t for _, t in held] + ["\u9fa5\u9fa4 the " + say("a", 3), "\u9fa5", "the cat"]
    got = parser.phrases([parser.symbols(t.encode()) for t in texts])
    for t, row in zip(texts, got):
        for name, n in zip(parser.names, row):
            rest, want = t, 0
            while rest:
                k = max([1, *(k for k in range(1, min(len(rest), 60) + 1) if rest[:k] in refs.texts[name])])
                rest, want = rest[k:], want + 1
            assert n == want
    bits = got * parser.bits
    assert [parser.names[i] for i in bits[: len(held)].argmin(1)] == [name for name, _ in held]
    assert len({int(parser.place[ord(c)]) for c in set("".join(refs.texts.values())) - {" "}}) > 118


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, again = (text or "").split("\n"), 0
    for i, line in enumerate(lines):
        again += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_rules_base_and_verdict(spark):
    got = quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.kept and r.base_failed)
    clean = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(bad) < 0.1


def test_quality_rules_odd_cases(spark):
    docs = frame(spark, ODD)
    got = quality_rules(docs).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got if r.n_words < 20)
    assert accepted(docs).columns == docs.columns and quality_rules(docs.limit(0)).count() == 0
    assert not len(references(docs.where("lang is null")).words)
    assert quality_rules(docs, refs=references(docs.limit(0))).where(F.col("class_distance").isNotNull()).count() == 0


def test_distances():
    assert jensen_shannon(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and jensen_shannon(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0
    assert np.bincount(class_table(), minlength=N_CLASSES + 1).sum() == 256
    assert repeated_words([b"x"] * 9, 8) == 9 and repeated_words([b"x"] * 8, 8) == 0 and repeated_words(list(map(str, range(20))) * 2, 8) == 40
    assert pytest.approx(float(jensen_shannon(np.array([0.25, 0.75]), np.array([0.5, 0.5]))) ** 2, abs=1e-12) == 0.5 * (0.25 * np.log2(0.25 / 0.375) + 0.75 * np.log2(0.75 / 0.625)) + 0.5 * (0.5 * np.log2(0.5 / 0.375) + 0.5 * np.log2(0.5 / 0.625))


def test_quality_model_does_not_depend_on_partitions_or_repeats(spark):
    r = np.random.default_rng(1)
    say = lambda k, n: " ".join(f"{k}{x}" for x in r.integers(0, 300, n))
    rows = [(i, say("good" if i % 3 else "bad", int(r.integers(5, 400)))) for i in range(300)]
    rows += [(i, f"another text {i} " * 40) for i in range(0, 300, 2)] * 3  # ids on two texts, and repeated rows
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] * 2 + [(7, 0), (8, 1)], "doc_id long, label int")
    one, other = (compression_quality.fit(frame(spark, rows[::step]).repartition(n), labels.repartition(n), sample=120) for n, step in ((1, 1), (7, -1)))
    assert one == other and isinstance(one, compression_quality.Model)
    few = compression_quality.fit(frame(spark, rows), labels, sample_bytes=4000)  # the bound in bytes holds for each label
    assert len(few.good) <= 4000 and len(few.bad) <= 4000 if isinstance(few, compression_quality.Model) else 0 <= few <= 1
    assert compression_quality.within([("a", 5), ("b", 9), ("c", 4), ("d", 1)], 10) == [("a", 5), ("c", 4), ("d", 1)]


def test_quality_scores_by_hand(spark):
    """Every chunk compressed with a dictionary that the library attaches by itself, the curve written out."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = compression_quality.fit(docs, labels)
    size = lambda raw, text: sum(len(zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False, write_checksum=False).compress(text[i : i + 512])) for i in range(0, len(text), 512))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in compression_quality.score_quality(docs, model).collect()[:60]:
        t = texts[r.doc_id]
        x = (size(model.good, t) - size(model.bad, t)) / len(t) if t else 0.0
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * x + model.offset))), abs=0.02)


def test_references_and_verdict_by_hand(spark):
    """Shares of classes and common words, distances and verdicts, written out over all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]

    def kind(c):
        if c in " \t\n\v\f\r":
            return 0
        if ord(c) > 127:
            return 6
        return 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>@[]\\^_`{}~/+=" else 7

    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    classes = lambda t: Counter(map(kind, t))
    wanted = {}
    for lang in sorted({x for _, _, x in rows if x is not None}):
        own = [t for _, t, x in rows if x == lang and words_of(t)]
        c, w, often = Counter(), Counter(), Counter(m for t in own for m in words_of(t))
        often = sorted(often, key=lambda k: (-often[k], k.encode()))[:64]  # the words that may be common
        for t in own:
            n, m = len(t), words_of(t)
            for k, v in classes(t).items():
                c[k] += v * 1_000_000 // n
            for k in often:
                w[k] += m.count(k) * 1_000_000 // len(m)
        wanted[lang] = ([c[k] / sum(c.values()) for k in range(N_CLASSES)], w, len(own) * 1_000_000)
    refs = references(docs)
    assert refs.langs == list(wanted)
    for lang, c, own, s in zip(refs.langs, refs.classes, refs.words, refs.shares):
        by_class, w, whole = wanted[lang]
        assert c == pytest.approx(by_class)
        best = sorted(w, key=lambda k: (-w[k], k.encode()))[: len(own)]
        assert [k.decode() for k in own] == best and s[:-1] == pytest.approx([w[k] / whole for k in best])

    def distance(p, q):
        half = lambda a, m: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return np.sqrt(max(0, half(p, m) + half(q, m)) / 2)

    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t, _ in rows:
        r, ws, n = got[i], words_of(t), len(t)
        by_class = min(distance([classes(t)[k] / n for k in range(N_CLASSES)], c) for c in refs.classes) if n >= 200 else None
        counts = Counter(ws)
        by_word = None
        if len(ws) >= 50:
            shares = [[counts[k.decode()] / len(ws) for k in own] for own in refs.words]
            by_word = min(distance([*p, 1 - sum(p)], q) for p, q in zip(shares, refs.shares))
        assert (r.class_distance is None) == (by_class is None) and (r.word_distance is None) == (by_word is None)
        assert by_class is None or r.class_distance == pytest.approx(by_class, abs=1e-6)
        assert by_word is None or r.word_distance == pytest.approx(by_word, abs=1e-6)
        assert r.kept == (not r.base_failed and (by_class or 0) <= 0.3 and (by_word or 0) <= 0.42)


def test_languages_without_a_reference_have_the_base_rule_alone(spark):
    r = np.random.default_rng(2)
    say = lambda k, n: " ".join(f"{k}{x}" for x in r.integers(0, 40, n))
    rows = [(i, say("ab", 200), "a") for i in range(30)] + [(100, "ÄÖÜ " + say("ÄÖ", 120), "b"), (101, "ÄÖÜ " + say("ÄÖ", 120), None), (102, "ÄÖÜ " + say("ÄÖ", 120), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: (x.kept, x.word_distance) for x in quality_rules(docs, refs=references(docs, languages=1)).collect()}
    assert got[100] == (True, None) and not got[101][0] and not got[102][0] and got[3][0]
    assert quality_rules(docs.drop("lang"), refs=references(docs, languages=1)).where("kept").count() == 30


def test_summaries_hand_on_what_is_too_much():
    import pyarrow as pa

    from tonegrid.llm.quality_rules import summaries

    texts = [("a", "x y " * 20), ("b", "p q r"), ("a", "x z"), ("c", "x"), (None, "n")] * 5
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts]), pa.array([t for _, t in texts])], names=["lang", "text"])
    want = Counter((k, w.encode()) for k, t in texts for w in t.split())
    for most in (1, 3, 1 << 20):
        found = Counter()
        for b in summaries(iter([batch]), 100, most):
            for k, w, n in zip(*(c.to_pylist() for c in b.columns)):
                found[k, w] += n
        assert found == want


def test_quality_rules_without_lang(spark):
    """A table without that column is as one where it is null."""
    docs = frame(spark, ODD)
    rules = lambda df: sorted(map(str, quality_rules(df).collect()))
    assert rules(docs.drop("lang")) == rules(docs.withColumn("lang", F.lit(None).cast("string")))
    kept = accepted(docs.drop("lang"))
    assert kept.columns == docs.drop("lang").columns and kept.count() == accepted(docs.withColumn("lang", F.lit(None).cast("string"))).count()


def test_tables_of_references_have_a_bound(monkeypatch):
    monkeypatch.setattr(language_id, "NEW", 1000)
    with pytest.raises(ValueError, match="table cells"):
        language_id.Parser(language_id.References({"a": "some words of text " * 9, "b": "andere worte " * 9}))
