"""Exact, near and line dedup against brute force, and on nulls, empty texts, ties, repeats and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm.common import cut, forget_all, likely_in, scratch, unused
from tonegrid.llm.exact_dedup import distinct_documents, exact_dedup, frequent
from tonegrid.llm.graph import components
from tonegrid.llm.line_dedup import clean_lines
from tonegrid.llm.near_dedup import Shingler, Sketcher, banding, distinct_groups, most_unlike, near_dedup, unlike

SCHEMA = "doc_id long, text string, row string, node string, kept int, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y", 0, 1) for i, t in rows], SCHEMA).repartition(parts)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c D e f"), (6, "one two"), (7, "one two"), (None, None), (8, "x " * 30_000)]


@pytest.mark.parametrize("rows", [[], ODD, [(i, f"t{i % 7}" if i % 3 else "hot") for i in range(300)]])
@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_dedup(spark, rows, counters):
    got = exact_dedup(frame(spark, rows), counters=counters).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(order):
            want[i, order[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_frequent_digests_are_found(spark):
    rows = [(i, "hot" if i % 4 == 0 else f"cold {i}") for i in range(2000)]
    digests = exact_dedup(frame(spark, rows, 7)).select("text_sha256")
    assert hashlib.sha256(b"hot").hexdigest() in {r[0] for r in frequent(digests, 10).collect()}


def test_distinct_documents_keeps_columns_and_one_row(spark):
    got = distinct_documents(frame(spark, ODD))
    assert got.columns == frame(spark, ODD).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({(2, ""): 1, (3, " \n\t"): 1, (4, "a b c d e f"): 1, (5, "A b c D e f"): 1, (7, "one two"): 1, (8, "x " * 30_000): 1})


def brute(rows, percent):
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        c = min(least[find(i)], default=None)
        out[d, len(sets[i]), c, d == c] += 1
    return out


def near_copies(n, words, edits, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(r.choice(edits)):
            own[r.randrange(words)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("rows", [[], ODD, near_copies(150, 150, [0, 1, 2, 3, 4], 1), near_copies(60, 40, [0, 1], 2) + [(1000 + i, f"own text {i} " * 5) for i in range(40)], near_copies(260, 200, [3, 4, 5, 6, 9], 4) + near_copies(40, 200, [3], 4) * 2])
def test_near_dedup(spark, rows, percent):
    got = near_dedup(frame(spark, rows), percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, percent)


def test_distinct_groups(spark):
    got = distinct_groups(frame(spark, ODD + [(20, "a b c d e f")])).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 4, 4, 6, 8]


def test_distinct_groups_tells_rows_apart_by_doc_id_and_text(spark):
    other, third = "quite another text of seven words", "and a third text that stands alone"
    rows = [
        (None, "a b c d e f"), (4, "a b c d e f"),  # linked: 4 stays, and that drops no other null doc_id
        (None, other), (None, None), (None, ""), (9, None),
        (30, "g h i j k l"), (31, "g h i j k l"), (31, third),  # 31 is a copy of 30, and also a text of its own
        (40, "m n o p q r"), (40, "M n o p q r"), (41, "m N o p q r"),  # one doc_id on two texts of a group
        (None, "s t u v w x"), (None, "s t u v w x"), (None, "S t u v w x"),  # a group without a doc_id
        (4, "a b c d e f"),
    ]
    for parts in (1, 5):
        got = Counter((r.doc_id, r.text) for r in distinct_groups(frame(spark, rows, parts)).collect())
        by_sha = lambda *texts: min(texts, key=lambda t: hashlib.sha256(t.encode()).digest())
        assert got == Counter([(4, "a b c d e f")] * 2 + [(None, other), (None, None), (None, ""), (9, None), (30, "g h i j k l"), (31, third), (40, by_sha("m n o p q r", "M n o p q r")), (None, by_sha("s t u v w x", "S t u v w x"))])
    assert distinct_groups(frame(spark, rows)).columns == frame(spark, rows).columns


def test_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    t, bands = banding(85)
    assert t == 160 and bands == 32
    assert 1 - (1 - 0.8**4) ** (banding(80)[1]) > 1 - 1e-8
    sketcher, off = Sketcher(t, bands), []
    for _ in range(200):
        both = r.integers(0, 2**63, 700, dtype=np.uint64)
        a, b = sketcher.sketch(both[:600]), sketcher.sketch(both[100:])
        off.append((a == b).mean() - 500 / 700)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.06
    for n in (1, 2, 30):  # every coordinate fills
        assert sketcher.sketch(r.integers(0, 2**63, n, dtype=np.uint64)).max() < np.iinfo(np.uint64).max


def test_shingles_need_all_five_words():
    s = Shingler(5)
    assert len(s(b"a b c d e f")) == 2 and len(s(b"a b")) == 1 and len(s(b"")) == 0 and len(s(None)) == 0
    assert s(b"A B c d e").tolist() == s(b"a\tb\nc d  e").tolist() and s("Ä b c d e".encode()).tolist() != s("ä b c d e".encode()).tolist()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 50)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {500 + i: 500 for i in range(50)}
    assert components(links.limit(0)).count() == 0


def test_clean_lines(spark):
    block = "First line of it\nsecond line\n\n third line "
    rows = [(3, f"own a\n{block}\nown b"), (5, f"{block}\nfourth"), (9, f"FIRST line of it\nsecond line\nthird line\nfourth\nlast"), (1, None), (2, ""), (None, "x"), (4, "q\n" * 10), (6, "two\nlines")]
    got = {r.doc_id: (r.clean_text, r.n_lines, r.n_removed) for r in clean_lines(frame(spark, rows)).collect()}
    assert got == {
        3: (rows[0][1], 5, 0), 5: ("\nfourth", 4, 3), 9: ("last", 5, 4), 1: (None, 0, 0), 2: ("", 0, 0), None: ("x", 1, 0),
        4: ("q\n", 10, 9), 6: ("two\nlines", 2, 0),
    }
    assert clean_lines(frame(spark, [])).count() == 0
    assert clean_lines(frame(spark, [(1, block), (1, block)])).where("n_removed > 0").count() == 0


def test_sketch_bytes_differ_as_counted(spark):
    r = np.random.default_rng(9)
    t, bands = banding(80)
    sketcher, rows = Sketcher(t, bands), []
    for _ in range(50):
        both = r.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = sketcher.sketch(both[:260]), sketcher.sketch(both[20:])
        rows.append((*(sketcher.low_bytes(x).view(np.int64).tolist() for x in (a, b)), int(((a ^ b) & np.uint64(255) != 0).sum())))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.where(f"{unlike('a', 'b')} != n").count() == 0
    assert most_unlike(160, 85) in range(50, 60) and most_unlike(10, 85) == 10


def test_bit_filter_misses_no_key(spark):
    df = spark.createDataFrame([(i, f"k{i}", i) for i in range(20_000)] + [(None, None, 0)], "a long, b string, __bit long")
    keys = df.where("a % 50 = 0 or a is null").select("b", "a")
    got = likely_in(df, [F.col("a"), F.col("b")], keys, [F.col("a"), F.col("b")])
    assert got.columns == [*df.columns, "likely"] and got.where("not likely and (a % 50 = 0 or a is null)").count() == 0
    assert got.where("likely").count() < 401 + 20_000 / 8 and likely_in(df, [F.col("a")], keys.limit(0), [F.col("a")]).where("likely").count() == 0


def test_tables_go_with_their_scope(spark):
    import os

    path = lambda t: t.cut_path.removeprefix("file:")
    with scratch(spark) as kept:
        one, two = cut(spark.range(3), "one"), cut(spark.range(4), "two")
        with scratch(spark) as inner:
            three, four = cut(spark.range(5), "three"), cut(spark.range(6), "four")
            inner.append(three)
        assert os.path.isdir(path(three)) and not os.path.isdir(path(four))
        kept.append(two)
    assert [os.path.isdir(path(t)) for t in (one, two, three)] == [False, True, False] and two.count() == 4
    forget_all(spark)
    assert not os.path.isdir(path(two))
    assert unused(["a", "__K0", "___k1"], "k0", "k1") == ["____k0", "____k1"]


CLASHING = ["__id", "__sha", "__d", "__digest", "__words", "__text", "__k0", "id", "sha", "row", "key", "node", "size", "__size", "__taken", "__n", "__cut", "__c0", "a.b", "__lang", "__also0", "likely", "slice", "lead"]


@pytest.mark.parametrize("name", ["exact", "near", "mix", "quality", "lines"])
def test_columns_with_clashing_names(spark, name):
    from tonegrid.llm.quality_rules import accepted
    from tonegrid.llm.source_mix import mixed_documents

    rows = [(i, f"text {i // 2} of " + " ".join(f"w{(i // 2 + j * j) % 211}" for j in range(60)), "en", f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in CLASHING])
    f = {"exact": distinct_documents, "near": distinct_groups, "mix": lambda d: mixed_documents(d, grain=8), "quality": accepted, "lines": lambda d: clean_lines(d, keep=[c for c in d.columns if c != "text"])}[name]
    plain, got = f(docs), f(wide)
    if name != "lines":
        assert got.columns == wide.columns
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) and plain.count()
    for c in CLASHING:
        assert got.where(F.col(f"`{c}`") != F.concat(F.lit(f"{c}:"), "doc_id")).count() == 0, c
