"""Books, packed bits, running values and the filter bank against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import books as K
from tonegrid.operators import filterbank as Q
from tonegrid.operators import frames as W
from tonegrid.operators import transforms as T
from tonegrid.operators.packing import packed
from tonegrid.operators.rate import rate_control
from tonegrid.operators.scans import clamped
from tonegrid.plans import book_queries

SF = "/root/testdata/sf0.001"


def shortest(weights, longest):
    """The least total of weight times length over all codes of these lengths, by trying all of them."""
    best = None
    for lengths in itertools.product(range(1, longest + 1), repeat=len(weights)):
        if sum(2.0**-n for n in lengths) <= 1:
            total = sum(w * n for w, n in zip(weights, lengths))
            best = total if best is None else min(best, total)
    return best


def test_code_lengths_are_the_shortest(spark):
    r = random.Random(2)
    rows = [(sorted(int(10 ** (4 * r.random())) + 1 for _ in range(n)),) for n in (2, 3, 4, 5, 6, 6)]
    for longest in (3, 4):
        got = spark.createDataFrame(rows, "w array<bigint>").select("w", K.package_merge(F.col("w"), longest).alias("n")).collect()
        for x in got:
            assert sum(2.0**-n for n in x.n) <= 1 and max(x.n) <= longest
            assert sum(w * n for w, n in zip(x.w, x.n)) == shortest(x.w, longest)


def test_words_are_prefix_codes_and_bits_decode(spark):
    """The given spectra: lengths fill the code space, no word begins another, and the packed bits give the values back."""
    words = {}
    for x in book_queries.book_lengths(spark, SF).collect():
        words.setdefault(x.book, {})[format(x.word, f"0{x.length}b")] = x.code
    assert {b: len(w) for b, w in words.items()} == {b: K.radix(b) ** n for b, (n, *_) in K.BOOKS.items()}
    for own in words.values():
        assert sum(2.0 ** -len(w) for w in own) == 1 and max(map(len, own)) <= K.LONGEST
        ordered = sorted(own)
        assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))
    books = {r.frame_no: list(map(int, r.books.split(","))) for r in book_queries.chosen_books(spark, SF).collect()}
    want = {(r.frame_no, r.sfb): r.q for r in book_queries.values(spark, SF).collect()}
    coded = book_queries.coded_spectra(spark, SF).collect()
    assert len(coded) > 300
    for r in coded:
        bits, at = "".join(format(b, "08b") for b in bytes.fromhex(r.hex))[: r.n_bits], 0
        for sfb, book in enumerate(books[r.frame_no]):
            values = []
            while book and len(values) < len(want[r.frame_no, sfb]):
                n, largest, signed = K.BOOKS[book]
                end = at + 1
                while bits[at:end] not in words[book]:
                    end += 1
                code, at = words[book][bits[at:end]], end
                digits = [code // K.radix(book) ** (n - 1 - k) % K.radix(book) for k in range(n)]
                own = [d - largest for d in digits] if signed else list(digits)
                if not signed:
                    for k, d in enumerate(digits):
                        if d:
                            own[k], at = (-d if bits[at] == "1" else d), at + 1
                if book == K.ESCAPE:
                    for k, d in enumerate(digits):
                        if d == largest:
                            ones = bits.index("0", at) - at
                            rest, at = bits[at + ones + 1 : at + 2 * ones + 5], at + 2 * ones + 5
                            own[k] = (-1 if own[k] < 0 else 1) * ((1 << (ones + 4)) + int(rest, 2))
                values += own
            assert (values or [0] * len(want[r.frame_no, sfb])) == want[r.frame_no, sfb]
        assert at == r.n_bits


def test_chosen_books_are_the_cheapest(spark):
    r, header = random.Random(4), 9
    rows = []
    for f in range(25):
        costs = []
        for _ in range(5):
            zero, lo = r.random() < 0.2, r.choice((1, 9, 11))
            costs.append([0] + [None] * 11 if zero else [None if k < lo else r.randint(0, 30) for k in range(12)])
        rows.append((f, costs))
    got = spark.createDataFrame(rows, "f int, costs array<array<int>>").select("f", "costs", K.cheapest_books(F.col("costs"), header).alias("x")).collect()

    def total(books, costs):
        return sum(c[b] for b, c in zip(books, costs)) + header * sum(i == 0 or b != books[i - 1] for i, b in enumerate(books))

    for x in got:
        allowed = [[k for k, c in enumerate(band) if c is not None] for band in x.costs]
        assert x.x.bits == total(x.x.books, x.costs) == min(total(b, x.costs) for b in itertools.product(*allowed))


def test_packed_fields(spark):
    r = random.Random(1)
    rows = [(s, i, r.getrandbits(40), r.randint(0, 32)) for s, n in ((1, 3000), (2, 1), (3, 33), (None, 5)) for i in range(n)]
    found = {}
    for x in packed(spark.createDataFrame(rows, "stream_id long, frame_no long, value long, width int").repartition(5), span=50, chunk_words=16).orderBy("stream_id", "chunk_no").collect():
        found.setdefault(x.stream_id, []).append(x)
    for s in (1, 2, 3):
        bits = "".join(format(v & ((1 << w) - 1), f"0{w}b") for t, _, v, w in rows if t == s and w)
        assert sum(x.n_bits for x in found.get(s, [])) == len(bits)
        whole = bits + "0" * (-len(bits) % 8)
        assert "".join(x.hex for x in found.get(s, [])) == (format(int(whole, 2), f"0{len(whole) // 4}X") if whole else "")


@pytest.mark.parametrize("span", [1, 7, 64, 5000])
def test_clamped_running_values(spark, span):
    r = random.Random(span)
    rows = [(s, i, r.randint(-50, 50), "x") for s, n in ((1, 700), (2, 64), (3, 1), (4, 129)) for i in range(n)]
    df = spark.createDataFrame(rows, "stream_id long, frame_no long, amount int, other string").repartition(3)
    sums = {(x.stream_id, x.frame_no): x.v for x in clamped(df, F.col("amount"), -60, 100, 20, "v", span=span).collect()}
    factors = {(x.stream_id, x.frame_no): x.v for x in clamped(df, 1 + F.col("amount") / 100, 0.5, 8.0, 1.0, "v", times=True, span=span).collect()}
    assert len(sums) == len(rows)
    for s in (1, 2, 3, 4):
        v, f = 20, 1.0
        for t, i, a, _ in rows:
            if t == s:
                v, f = min(100, max(-60, v + a)), min(8.0, max(0.5, f * (1 + a / 100)))
                assert sums[s, i] == v and factors[s, i] == pytest.approx(f, rel=1e-12)


def test_rate_control_follows_the_frames(spark):
    """The scans against one loop over the frames."""
    sizes = np.random.default_rng(4).lognormal(7.5, 1, 400).astype(int).tolist()
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(sizes)], "stream_id long, frame_no long, bits long")
    for constant, rate in ((True, 64_000), (False, 48_000), (True, 574_000)):
        got = sorted(rate_control(rows, 2, rate, 48_000, constant, span=16).collect(), key=lambda r: r.frame_no)
        budget = 2 * rate * 1024 // 48_000
        cap = max(0, 2 * 6144 - budget) if constant else 0
        fill, balance, quality, before, target = cap // 2, 0, 100.0, 0, int(0.99 * budget)
        for r, bits in zip(got, sizes):
            low = max(0, min(budget + fill - cap, budget + fill - 16)) if constant else 0
            sent = max(bits, low)
            fill = min(cap, max(0, fill + budget - sent)) if constant else 0
            balance = min(4 * budget, max(-4 * budget, balance + target - bits))
            aim = target + int(balance / 32)
            floored, capped = constant and aim < budget + fill - cap, constant and bits > budget + fill
            if constant:
                aim = min(max(aim, budget + fill - cap), budget + fill)
            fix = aim / bits if bits else 1.0
            share = 0.5 + 0.5 * balance / (4 * budget)
            fix = min(fix, 1.5) if floored else max(fix, 0.5) if capped else 1 + (fix - 1) * (0.6 if 0.25 <= share <= 0.75 else 0.85)
            if fix > 1 and sent > bits and before and bits <= before + before // 50:
                fix = 1.0
            if abs(fix - 1) > 0.005:
                quality *= fix if floored or capped else min(1.2, max(0.8, fix))
            quality, before = min(5000.0, max(1.0, quality)), bits if sent > bits else 0
            assert (r.sent, r.fill, r.balance) == (sent, fill, balance) and r.quality == pytest.approx(quality, rel=1e-10)


def test_peak_rate_of_uneven_frames(spark):
    r = random.Random(6)
    rows = [(s, i, r.randint(0, 900), r.choice((100, 960, 1024)) if s != 3 else 0) for s, n in ((1, 600), (2, 5), (3, 4), (4, 60)) for i in range(n)]
    got = {x.stream_id: x.peak_rate for x in W.kept_peak_rate(spark.createDataFrame(rows, "stream_id long, frame_no long, size long, duration long").repartition(3), 8000).collect()}
    want = {}
    for s in (1, 2, 3, 4):
        longest = size = lasts = most = 0
        for t, _, n, d in rows:
            if t == s:
                longest = max(longest, d)
                if d == longest:
                    size, lasts = size + n, lasts + d
                    if lasts >= 8000:
                        most, size, lasts = max(most, size * 8 * 8000 // lasts), 0, 0
        want[s] = most
    assert got == want


@pytest.mark.parametrize("bands,slots", [(8, 4), (64, 32), (4, 16)])
def test_filter_bank_remembers(spark, bands, slots):
    """Any frame length gives the energies and the half rate that the whole signal has."""
    x = np.random.default_rng(bands).normal(size=3 * bands * slots + bands // 2 + 1)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 1.0)], "stream_id long, sample_no long, x double").repartition(4)
    got = sorted((r for r in Q.analysed(df, bands, slots).collect() if r.stream_id == 1), key=lambda r: r.frame_no)
    whole = np.concatenate([np.zeros(Q.TAPS * bands), x, np.zeros(len(got) * bands * slots - len(x))])
    for r in got:
        for s in range(slots):
            end = Q.TAPS * bands + (r.frame_no * slots + s + 1) * bands
            assert np.allclose(r.bank[s], T.subband_energies(whole[None, end - Q.TAPS * bands : end], bands)[0])
            assert r.slot_energy[s] == pytest.approx((whole[end - bands : end] ** 2).sum())
    half = {r.sample_no: r.x for r in W.decimate(df.where("stream_id = 1")).collect()}
    mine = [v for r in got for v in r.half]
    assert all(mine[k] == pytest.approx(v) for k, v in half.items())
