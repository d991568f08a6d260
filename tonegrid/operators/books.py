"""Code lengths of values, bits of bands in every book, the cheapest books along a frame's bands, and codewords.

A spectral book codes two or four neighbouring values at a time; their mixed-radix number is its index. Lengths are a small
table (book, code, length): a row for each index of each book, 1,241 in all, built from the values themselves. Bits of bands
come from a broadcast join with it and one sum; the search for the books is a fold over a frame's bands in its row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each book's values at a time, largest magnitude, and whether values keep their sign (others send signs apart). The
#: format's fixed values.
BOOKS = {1: (4, 1, True), 2: (4, 1, True), 3: (4, 2, False), 4: (4, 2, False), 5: (2, 4, True), 6: (2, 4, True), 7: (2, 7, False), 8: (2, 7, False), 9: (2, 12, False), 10: (2, 12, False), 11: (2, 16, False)}
#: The book that escapes larger values, and the longest codeword.
ESCAPE, LONGEST = 11, 16
N_STATES = ESCAPE + 1


def power(n: Column) -> Column:
    """2 ** n as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def radix(book: int) -> int:
    _, largest, signed = BOOKS[book]
    return 2 * largest + 1 if signed else largest + 1


def code_of(values: Sequence[Column], book: int) -> Column:
    """The mixed-radix number of consecutive values; magnitudes over the largest count as it."""
    _, largest, signed = BOOKS[book]
    code = F.lit(0)
    for v in values:
        code = code * radix(book) + (v + largest if signed else F.least(F.abs(v), F.lit(largest)))
    return code.cast("int")


def escape_bits(v: Column) -> Column:
    """Bits that a magnitude adds to its codeword in the escape book."""
    most = BOOKS[ESCAPE][1]
    return F.when(F.abs(v) >= most, 2 * F.floor(F.log2(F.abs(v) + F.lit(0.5))).cast("int") - 3).otherwise(0)


def fits(most: Column, book: int) -> Column:
    """Whether a band with that largest magnitude may use the book: those of the lowest pair that holds it, and above."""
    largest = BOOKS[book][1]
    return F.lit(True) if book == ESCAPE else most <= largest


def band_codes(bands: DataFrame, keys: list[str], q: str = "q") -> DataFrame:
    """The keys, book, at (place of the tuple in its band), code, and extra: bits besides the codewords. bands: the keys and q,
    a band's values, a multiple of four of them. Bands of zeros have no codes."""
    most = F.array_max(F.transform(q, F.abs))
    def tuple_of(book: int) -> Callable[[Column], Column]:
        n, _, signed = BOOKS[book]

        def one(i: Column) -> Column:
            values = [F.get(F.col(q), i * n + k) for k in range(n)]
            signs = F.lit(0) if signed else sum((F.when(v != 0, 1).otherwise(0) for v in values), F.lit(0))
            extra = sum(map(escape_bits, values), signs) if book == ESCAPE else signs
            return F.struct(F.lit(book).alias("book"), i.alias("at"), code_of(values, book).alias("code"), extra.cast("int").alias("extra"))

        return one

    spread = []
    for book, (n, *_) in BOOKS.items():
        tuples = F.transform(F.sequence(F.lit(0), (F.size(q) / n).cast("int") - 1), tuple_of(book))
        spread.append(F.when(fits(F.col("most"), book), tuples).otherwise(F.array().cast("array<struct<book:int,at:int,code:int,extra:int>>")))
    coded = bands.withColumn("most", most).where("most > 0").select(*keys, F.explode(F.concat(*spread)).alias("c"))
    return coded.select(*keys, "c.*")


def package_merge(weights: Column, longest: int = LONGEST) -> Column:
    """Lengths of an optimal prefix code of at most ``longest`` bits for weights in rising order (two or more of them).

    Level after level, neighbours of the sorted list are packed in pairs and merged with the single symbols; of the last
    list the first 2n - 2 items are taken, and of each list before it the two items of each pack taken. A symbol's length
    is the number of lists in which it is taken. ``longest`` steps over lists of fewer than 2n items."""
    item = "struct<w: bigint, leaf: int>"
    leaves = F.transform(weights, lambda w: F.struct(w.cast("bigint").alias("w"), F.lit(1).alias("leaf")).cast(item))

    def packed(last: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), (F.size(last) / 2).cast("int") - 1), lambda i: F.struct((F.get(last, 2 * i).w + F.get(last, 2 * i + 1).w).alias("w"), F.lit(0).alias("leaf")).cast(item))
        return F.array_sort(F.concat(leaves, pairs))

    lists = F.aggregate(F.sequence(F.lit(2), F.lit(longest)), F.array(leaves).cast(f"array<array<{item}>>"), lambda all_, _: F.concat(all_, F.array(packed(F.element_at(all_, -1)))).cast(f"array<array<{item}>>"))
    acc = "struct<take: int, taken: array<int>>"

    def down(s: Column, level: Column) -> Column:
        singles = F.aggregate(F.slice(level, F.lit(1), s.take), F.lit(0), lambda n, x: n + x.leaf)
        return F.struct((2 * (s.take - singles)).alias("take"), F.concat(s.taken, F.array(singles)).alias("taken")).cast(acc)

    start = F.struct((2 * F.size(weights) - 2).alias("take"), F.array().cast("array<int>").alias("taken")).cast(acc)
    taken = F.aggregate(F.reverse(lists), start, down, lambda s: s.taken)
    return F.transform(weights, lambda _, i: F.size(F.filter(taken, lambda m: m > i)))


def code_lengths(codes: DataFrame, second: Column, longest: int = LONGEST) -> DataFrame:
    """book, code and length for every index of every book, from how often each occurs in ``codes`` (of band_codes) and
    once more. Of the two books of one shape, the first is fitted to the codes that ``second`` doesn't name, the second
    to those that it does. The counts take a pass over the codes; the table has 1,241 rows whatever they are, and is made
    here, once."""
    spark = codes.sparkSession
    every = spark.createDataFrame([(b, c) for b, (n, *_) in BOOKS.items() for c in range(radix(b) ** n)], "book int, code int")
    used = codes.where((F.col("book") == ESCAPE) | (second == (F.col("book") % 2 == 0))).groupBy("book", "code").agg(F.count(F.lit(1)).alias("n"))
    counted = every.join(used, ["book", "code"], "left")
    lists = counted.groupBy("book").agg(F.array_sort(F.collect_list(F.struct((F.coalesce("n", F.lit(0)) + 1).alias("w"), "code"))).alias("symbols"))
    sized = lists.select("book", "symbols", package_merge(F.transform("symbols", lambda s: s.w), longest).alias("lengths"))
    made = sized.select("book", F.explode(F.arrays_zip("symbols", "lengths")).alias("z")).select("book", F.col("z.symbols.code").alias("code"), F.col("z.lengths").alias("length"))
    return spark.createDataFrame(made.collect(), "book int, code int, length int").coalesce(1)


def codewords(lengths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Adds word, the canonical prefix code of these lengths: shorter ones first, of equal ones by their index."""
    order = Window.partitionBy("book").orderBy("length", "code").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(power(longest - F.col("length"))).over(order), F.lit(0))
    return lengths.withColumn("word", F.call_function("shiftright", taken, longest - F.col("length")))


def small(table: DataFrame, rows: int = 10_000) -> DataFrame:
    """A broadcast of a table whose number of rows is checked."""
    if (n := table.limit(rows + 1).count()) > rows:
        raise ValueError(f"a table of codes has at most {rows} rows")
    return F.broadcast(table)


def book_bits(codes: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, book and bits of each band in every book it may use. lengths: book, code, length."""
    found = codes.join(small(lengths.select("book", "code", "length")), ["book", "code"])
    return found.groupBy(*keys, "book").agg(F.sum(F.col("length") + F.col("extra")).cast("int").alias("bits"))


def cost_arrays(frames: DataFrame, bits: DataFrame, frame: str, n_bands: int) -> DataFrame:
    """frame and costs for each row of ``frames``: for each of its bands an array of bits by book, null where a book
    doesn't fit. A band without codes has only zeros: book 0, which costs nothing. bits: frame, sfb, book, bits."""
    own = bits.groupBy(frame).agg(F.collect_list(F.struct("sfb", "book", "bits")).alias("found"))
    own = frames.select(frame).join(own, frame, "left").withColumn("found", F.coalesce("found", F.array().cast(own.schema["found"].dataType)))
    states = F.sequence(F.lit(0), F.lit(N_STATES - 1))

    def band(i: Column) -> Column:
        mine = F.filter("found", lambda x: x.sfb == i)
        of = lambda k: F.get(F.filter(mine, lambda x: x.book == k), F.lit(0)).bits
        return F.when(F.size(mine) == 0, F.transform(states, lambda k: F.when(k == 0, 0))).otherwise(F.transform(states, of))

    return own.select(frame, F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), band).alias("costs"))


def cheapest_books(costs: Column, header: int) -> Column:
    """bits and books: the books of the bands with the least bits in all, where a band that changes the book opens a
    section of ``header`` bits. The fold keeps for each book the least bits so far and which book the band before has;
    staying wins a tie, and of equal books the lowest. The books are then read back from the last band."""
    acc = "struct<dp: array<int>, back: array<array<int>>>"
    lowest = lambda dp: F.coalesce(F.array_position(dp, F.array_min(dp)).cast("int") - 1, F.lit(0))

    def step(s: Column, c: Column) -> Column:
        opened = F.coalesce(F.array_min(s.dp), F.lit(0)) + header
        stays = lambda d: d.isNotNull() & (d <= opened)
        dp = F.zip_with(s.dp, c, lambda d, x: F.when(x.isNotNull(), x + F.when(stays(d), d).otherwise(opened)))
        back = F.transform(s.dp, lambda d, k: F.when(stays(d), k).otherwise(lowest(s.dp)))
        return F.struct(dp.alias("dp"), F.concat(s.back, F.array(back)).alias("back")).cast(acc)

    start = F.struct(F.array_repeat(F.lit(None).cast("int"), N_STATES).alias("dp"), F.array().cast("array<array<int>>").alias("back")).cast(acc)
    trail = "struct<k: int, books: array<int>>"

    def read_back(s: Column) -> Column:
        first = F.struct(lowest(s.dp).alias("k"), F.array().cast("array<int>").alias("books")).cast(trail)
        walk = lambda t, back: F.struct(F.get(back, t.k).alias("k"), F.concat(F.array(t.k), t.books).alias("books")).cast(trail)
        return F.struct(F.array_min(s.dp).alias("bits"), F.aggregate(F.reverse(s.back), first, walk, lambda t: t.books).alias("books"))

    return F.aggregate(costs, start, step, read_back)


def book_fields(codes: DataFrame, chosen: DataFrame, words: DataFrame, frame: str, values: DataFrame) -> DataFrame:
    """Bit fields of the bands' values in their chosen books: frame, at (sfb, tuple, part), value and width. A tuple's
    codeword comes first, then the signs of its values that aren't zero, then the escapes of large ones. chosen: frame,
    sfb, book; words: of ``codewords``; values: frame, sfb, q."""
    used = codes.join(chosen, [frame, "sfb", "book"]).join(small(words), ["book", "code"]).join(values, [frame, "sfb"])
    shapes = F.array(*[F.lit(n) for n, *_ in BOOKS.values()])
    n, signed = F.element_at(shapes, F.col("book")), F.element_at(F.array(*[F.lit(s) for *_, s in BOOKS.values()]), F.col("book"))
    own = F.slice("q", F.col("at") * n + 1, n)
    loud = F.filter(own, lambda v: v != 0)
    signs = F.when(signed, F.array().cast("array<int>")).otherwise(F.transform(loud, lambda v: F.when(v < 0, 1).otherwise(0)))
    sign_field = F.struct(F.aggregate(signs, F.lit(0).cast("bigint"), lambda s, x: s * 2 + x).alias("value"), F.size(signs).alias("width"))
    large = F.when(F.col("book") == ESCAPE, F.filter(own, lambda v: F.abs(v) >= BOOKS[ESCAPE][1])).otherwise(F.array().cast("array<int>"))

    def escape(v: Column) -> Column:
        high = F.floor(F.log2(F.abs(v) + F.lit(0.5))).cast("int")
        return F.struct(((power(high - 3) - 2) * power(high) + F.abs(v) - power(high)).alias("value"), (2 * high - 3).alias("width"))

    parts = F.concat(F.array(F.struct(F.col("word").alias("value"), F.col("length").alias("width"))), F.filter(F.array(sign_field), lambda f: f.width > 0), F.transform(large, escape))
    return used.select(frame, "sfb", F.col("at").alias("tuple"), F.posexplode(parts).alias("part", "f")).select(frame, F.struct("sfb", "tuple", "part").alias("at"), "f.value", "f.width")
