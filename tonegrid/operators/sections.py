"""Codebook sections: a small search along a frame's bands, folded in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest magnitude that each codebook holds, by number; the first holds only zeros, the last any.
LARGEST = (0, 1, 1, 2, 2, 4, 4, 7, 7, 12, 12, 8191)


def fixed_length_costs(q: Column, tables: tuple[int, ...] = LARGEST) -> Column:
    """Bits of a band's magnitudes in each codebook under a rule: a fixed number of bits a line, enough for all values
    the book holds; null where it doesn't hold them. Measured code lengths can take this table's place."""
    most = F.array_max(q)
    per_line = [max(0, (2 * top).bit_length()) for top in tables]
    return F.array(*[F.when(most <= top, F.size(q) * n) for top, n in zip(tables, per_line)])


def cheapest_sections(costs: Column, header: int) -> Column:
    """The least bits for a frame's bands: each band takes a codebook, and a change of book costs a section header.
    costs: an array of bands, each an array of bits by codebook. The fold keeps the least bits so far for each book."""
    low = lambda a: F.array_min(a)

    def step(so_far: Column, band: Column) -> Column:
        change = low(so_far) + header
        return F.zip_with(so_far, band, lambda s, c: F.when(c.isNotNull(), F.when(s.isNull() | (change < s), change).otherwise(s) + c))

    # before the first band no book is open: every one costs its header
    start = F.transform(F.get(costs, F.lit(0)), lambda _: F.lit(header))
    return F.aggregate(costs, start, step, lambda s: low(s))
