"""Exact top-k search by inner product, in three phases with a uniform threshold.

A score is a sum over groups of components, so a query has one list of local scores for each group; candidates lie in
blocks, and a task holds one block of queries and one of candidates.

1. Gather: each task lists, for each of its queries and groups, the k candidates with the highest local scores, adds up
   their totals and hands on the k best. The k-th best of all that a query is handed is a safe cutoff: so many
   candidates reach it.
2. Collect: the cutoff goes along with its query to every block of candidates. A candidate whose local scores all lie
   below the cutoff divided by the number of groups has a total below the cutoff, so the entries at or over that
   uniform threshold in one group at least are sufficient.
3. Resolve: totals of the collected candidates are made exact; those that reach the cutoff, k a query and block at most,
   are ranked.

Equal scores rank by smaller vec_id (null last), also in cutoffs, so vectors that very many rows share leave no more
than k rows a query and block. The search itself compares every query with every candidate, in blocks of bounded size.

Components become floor(scale * x). Vectors that are null, or hold a null, NaN or infinite component (before or after
scaling), take no part; shorter vectors count as filled up with zeros, so an empty one scores 0. Totals are whole
numbers and exact: floats where they hold all sums that can occur, else Python's integers, cut off at the ends of a long.
A row is no candidate of its own, but rows that repeat it are. Repeated queries are answered each. An empty table gives
an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch

#: Queries of a block that a task scores at a time.
AT_ONCE = 256
LONG = np.iinfo(np.int64)


def matrix(lists: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """A row of floor(scale * x) for each list, as doubles, filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


class Scores:
    """Local scores of blocks of vectors, a group of components each; every sum is exact."""

    def __init__(self, asked: np.ndarray, others: np.ndarray, groups: int) -> None:
        most = max(1, asked.shape[1]) * max(1.0, np.abs(asked).max(initial=0)) * max(1.0, np.abs(others).max(initial=0))
        if most * groups < 2**24:
            kind = np.float32
        elif most * groups < 2**53:
            kind = np.float64
        else:
            kind = object
        whole = (lambda x: np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)) if kind is object else (lambda x: x.astype(kind))
        edges = np.linspace(0, asked.shape[1], groups + 1).astype(int)
        self.parts = [(whole(asked[:, a:b]), whole(others[:, a:b].T)) for a, b in zip(edges, edges[1:])]

    def local(self, rows: slice) -> list[np.ndarray]:
        return [q[rows] @ c if q.shape[1] else np.zeros((len(q[rows]), c.shape[1])) for q, c in self.parts]

    @staticmethod
    def totals(local: list[np.ndarray], where: tuple) -> np.ndarray:
        """Exact sums over the groups for the entries at these indexes."""
        total = sum(x[where].astype(object if x.dtype == object else np.float64) for x in local)
        return np.array([min(max(int(x), LONG.min), LONG.max) for x in total], np.int64) if total.dtype == object else total.astype(np.int64)


def best(order: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest of each row; among equals those further left."""
    n = order.shape[1]
    if order.dtype == object:
        return np.array([sorted(range(n), key=lambda j: (-row[j], j))[:k] for row in order], int).reshape(len(order), -1)
    # whole numbers under 2^24 leave room for the place; larger ones are sorted
    if np.abs(order).max(initial=0) * (2 * n) < 2**52:
        return np.argpartition(np.arange(n, dtype=np.float64) - order.astype(np.float64) * n, min(k, n) - 1, axis=1)[:, :k]
    return np.argsort(-order, axis=1, kind="stable")[:, :k]


def gathered(local: list[np.ndarray], own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a piece: its number, the places of the listed candidates and their totals."""
    lists = np.concatenate([best(x, k + 1) for x in local], axis=1)  # one more, as the query itself may be among them
    for i, places in enumerate(lists):
        places = np.unique(places)
        places = places[places != own[i]]
        yield i, places, Scores.totals(local, (i, places))


def collected(local: list[np.ndarray], own: np.ndarray, cutoffs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for the entries that reach the uniform threshold in one group at least, and the cutoff in all."""
    enough = np.zeros(local[0].shape, bool)
    for x in local:
        enough |= (x if x.dtype == object else x.astype(np.float64)) * len(local) >= cutoffs[:, None]
    rows, places = np.nonzero(enough)
    totals = Scores.totals(local, (rows, places))
    stays = (totals >= cutoffs[rows]) & (places != own[rows])
    rows, places, totals = rows[stays], places[stays], totals[stays]
    ends = np.searchsorted(rows, np.arange(len(own) + 1))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        yield i, places[a:b], totals[a:b]


def top_k(vectors: DataFrame, asks: Column, k: int = 20, scale: float = 64.0, groups: int = 2, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``vectors`` (vec_id, embedding) that ``asks`` selects, the k
    rows with the highest inner products."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(scale)) < F.lit(float("inf"))))
    with scratch(vectors.sparkSession) as kept:
        own = vectors.where(x.isNotNull() & usable).select(F.col("vec_id").cast("long").alias("id"), x.alias("x"), F.coalesce(asks, F.lit(False)).alias("asks"))
        rows = cut(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
        n, n_asked, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        blocks, asked_blocks = (max(1, -(-m // block_rows)) for m in (n, n_asked))
        place = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        named = lambda *names: [F.col(a).alias(b) for a, b in zip(("row", "id", "x"), names)]
        asked = rows.where("asks").select(*named("of", "asked", "given"), place(asked_blocks).alias("qb"))
        others = rows.select(*named("row", "id", "x"), place(blocks).alias("cb")).withColumn("qb", every(asked_blocks))

        def scored(asked: DataFrame, pick: Callable) -> DataFrame:
            """of, asked, id, score: what ``pick`` takes from each pair of blocks, the k best a query."""

            def run(left: pa.Table, right: pa.Table) -> pa.Table:
                right = right.sort_by([("id", "ascending"), ("row", "ascending")])  # places follow ids, nulls last
                q, c = left.combine_chunks(), right.combine_chunks()
                scores = Scores(*(matrix(t.column(x).combine_chunks(), width, scale) for t, x in ((q, "given"), (c, "x"))), groups)
                numbers = {r: i for i, r in enumerate(c.column("row").to_pylist())}
                own = np.array([numbers.get(r, -1) for r in q.column("of").to_pylist()], int)
                limits = np.array([float("-inf") if s is None else s for s in q.column("cutoff").to_pylist()], object if scores.parts[0][0].dtype == object else float)
                froms, tos, totals = [], [], []
                for a in range(0, len(own) if c.num_rows else 0, AT_ONCE):
                    piece = slice(a, a + AT_ONCE)
                    for i, places, found in pick(scores.local(piece), own[piece], limits[piece]):
                        first = np.lexsort((places, -found.astype(np.float64) if found.size and np.abs(found.astype(np.float64)).max() < 2**53 else [-int(f) for f in found]))[:k]
                        froms.append(np.full(len(first), a + i)), tos.append(places[first]), totals.append(found[first])
                at = lambda xs: pa.array(np.concatenate(xs or [np.empty(0, int)]).astype(np.int64))
                return pa.table([q.column("of").take(at(froms)), q.column("asked").take(at(froms)), c.column("id").take(at(tos)), at(totals)], names=["of", "asked", "id", "score"])

            dealt = asked.withColumn("cb", every(blocks)).groupBy("qb", "cb")
            return dealt.cogroup(others.groupBy("qb", "cb")).applyInArrow(run, "of long, asked long, id long, score long")

        order = Window.partitionBy("of").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        lists = scored(asked.withColumn("cutoff", F.lit(None).cast("long")), lambda local, own, _: gathered(local, own, k))
        cutoffs = lists.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").where(f"rank = {k}").select("of", F.col("score").alias("cutoff"))
        limited = asked.join(cutoffs, "of", "left")
        found = scored(limited, collected)
        kept.append(cut(found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select(F.col("asked").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"), "top"))
    return kept[0]
