"""MinHash near-dedup on sets of word shingles: fast similarity sketching, banding, exact verification.

1. Sketch: rounds of hashed bin placement. In round i < t every shingle goes to a hashed bin with value (i, hash)
   and a bin keeps its smallest value; in round t + j every shingle goes to bin j, so every coordinate is filled
   after 2t rounds, and mostly after few. A coordinate agrees in two sketches with the probability of their Jaccard
   similarity, concentrated as if all t coordinates had been drawn apart.
2. Documents with equal sets form a class; from here on there is one node for each class.
3. Banding: a bucket holds the classes that agree on all coordinates of a band. The bucket's smallest node leads;
   each other node is a candidate pair with the leader, so pairs are linear in the bucket's size.
4. A pair whose sketches agree in far fewer coordinates than a pair at the limit does is no candidate (the limit is set
   so that a pair at the limit is lost with probability 1e-9 at most). The others are verified on full sets, and links
   give components.
5. What the leaders leave open: pairs of one bucket whose components differ. Buckets try further leaders, still one
   pair for each node, while the pairs left are many; then each pair left is tried, but for those that an exact
   bound excludes. Of a node's shingles only those count that some other open node has too, and they are counted
   in 64 hashed bins: two nodes have at most the sum of the bins' smaller counts in common. So a node whose bins
   hold less than the limit times its set has no link at all, and a pair is
   left only if that sum is enough for the limit. Components are then final.

Bands are as many as it takes for a pair at the limit to share no bucket with probability 1e-8 at most. Where one node
has very many pairs, its facts are joined in slices, so that no task has all of them.

Nulls: a null text is an empty set; a null doc_id has no say in a component's smallest doc_id unless all are null.
Empty sets are linked with nothing. Repeated rows have equal sets, so they share a component. An empty table gives
an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICES, checked_broadcast, cut, drop_keys, held, keep_keys, likely_in, map_text, scratch
from .graph import components

CACHED_WORDS = 200_000
#: Buckets try up to so many further leaders while more than so many pairs a row are left; then all pairs left.
LEADER_TURNS, PAIRS_A_NODE = 2, 2


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift, twice."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """The distinct hashed shingles of ``width`` lower-case words; of fewer words, their whole sequence."""

    def __init__(self, width: int) -> None:
        self.width, self.hashes = width, WordHashes()
        self.factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        if 0 < len(h) < self.width:
            return mixed((h * self.factors[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
        n = max(0, len(h) - self.width + 1)
        total = np.zeros(n, np.uint64)
        for i, c in enumerate(self.factors):
            total += h[i : i + n] * c
        return np.unique(mixed(total))


class Sketcher:
    """Fast similarity sketches with t coordinates of sets of 64-bit hashes."""

    def __init__(self, t: int, bands: int) -> None:
        self.t, self.bands = t, bands
        self.seeds = mixed(np.arange(2 * t, dtype=np.uint64) + np.uint64(0x51ED2701))
        self.factors = mixed(np.arange(1, t // bands + 1, dtype=np.uint64)) | np.uint64(1)

    def sketch(self, items: np.ndarray) -> np.ndarray:
        t, low = self.t, np.uint64(0xFFFFFFFF)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        at_once = max(1, int(1.3 * t * np.log(t) / len(items)))  # rounds; more than needed do no harm
        for i in range(0, t, at_once):
            rounds = np.arange(i, min(t, i + at_once), dtype=np.uint64)[:, None]
            h = mixed(items ^ self.seeds[i : i + len(rounds), None])
            bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            np.minimum.at(out, bins.ravel(), ((rounds << np.uint64(32)) | (h & low)).ravel())
            if out.max() < np.iinfo(np.uint64).max:
                return out
        for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
            out[j] = (np.uint64(t + j) << np.uint64(32)) | (mixed(items ^ self.seeds[t + j]) & low).min()
        return out

    def low_bytes(self, sketch: np.ndarray) -> np.ndarray:
        """A byte of each coordinate, eight in a long; bytes that fill the last one up are 0."""
        out = np.zeros(-(-self.t // 8) * 8, np.uint8)
        out[: self.t] = sketch & np.uint64(0xFF)
        return out.view(np.uint64)

    def band_keys(self, sketch: np.ndarray) -> np.ndarray:
        rows = (mixed(sketch).reshape(self.bands, -1) * self.factors).sum(1)
        return mixed(rows + np.arange(self.bands, dtype=np.uint64) * self.seeds[0])


def lists(arrays: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0] + [0 if a is None else len(a) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([a for a in arrays if a is not None] or [np.empty(0, np.uint64)]).view(np.int64)))


def halves(items: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(items.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def sketched(docs: DataFrame, width: int, t: int, bands: int, keep: list[str]) -> DataFrame:
    def make() -> Callable:
        shingle, sketcher = held(("shingles", width), lambda: Shingler(width)), Sketcher(t, bands)

        def work(texts: list) -> list:
            sets = [shingle(x) for x in texts]
            d1, d2 = zip(*map(halves, sets))
            return [[len(s) for s in sets], d1, d2, lists([sketcher.band_keys(sketcher.sketch(s)) if len(s) else None for s in sets])]

        return work

    return map_text(docs.select(*keep, "text").withColumn("row", F.monotonically_increasing_id()), "text", [*keep, "row"], "n long, d1 long, d2 long, keys array<long>", make)


def sets_of(docs: DataFrame, nodes: DataFrame, width: int, t: int, bands: int, repeats: bool) -> DataFrame:
    """node, its full set and a byte of each coordinate of its sketch, for nodes (node, doc_id, d1, d2). Only texts
    whose doc_ids are likely among those of nodes are worked on again. ``repeats``: whether rows may share a node's
    doc_id and set, so that one has to be chosen."""

    def make() -> Callable:
        shingle, sketcher = held(("shingles", width), lambda: Shingler(width)), Sketcher(t, bands)

        def work(texts: list) -> list:
            sets = [shingle(x) for x in texts]
            d1, d2 = zip(*map(halves, sets))
            return [d1, d2, lists(sets), lists([sketcher.low_bytes(sketcher.sketch(x)) if len(x) else None for x in sets])]

        return work

    texts = likely_in(docs.select("doc_id", "text"), [F.col("doc_id")], nodes, [F.col("doc_id")]).where("likely")
    found = map_text(texts, "text", ["doc_id"], "d1 long, d2 long, items array<long>, low array<long>", make)
    small = checked_broadcast(nodes.select("node", F.col("doc_id").alias("id"), F.col("d1").alias("e1"), F.col("d2").alias("e2")))
    same = F.expr("doc_id <=> id and d1 = e1 and d2 = e2")
    made = found.join(small, same).select("node", "items", "low")
    return cut(made.dropDuplicates(["node"]) if repeats else made, "sets")


def with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (a, b) with facts (node and others) of both, as other_a and other_b. A node that stands in many pairs as a
    meets them in slices."""
    names = [c for c in facts.columns if c != "node"]
    needed = likely_in(facts, [F.col("node")], pairs.select("a").union(pairs.select("b")), [F.col("a")]).where("likely").drop("likely")
    of = lambda x: needed.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names])
    sliced = pairs.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(SLICES)))
    first = sliced.select("a", "slice").distinct().join(of("a"), "a")
    return sliced.join(of("b"), "b").join(first, ["a", "slice"]).drop("slice")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with the sizes of their sets and of the intersection, from full sets."""
    both = with_facts(cut(pairs.select("a", "b").distinct(), "candidates"), sets.select("node", "items"))
    sized = both.select("a", "b", F.size("items_a").alias("na"), F.size("items_b").alias("nb"), F.size(F.array_intersect("items_a", "items_b")).alias("common"))
    return cut(sized.withColumn("either", F.expr("na + nb - common")), "verified")


def most_unlike(t: int, percent: int, missed: float = 1e-9) -> int:
    """In how many of t coordinates the sketches of a pair at ``percent`` differ at most, but for that probability."""
    p = 1 - percent / 100
    tail, k = 0.0, t
    while k and tail + (own := comb(t, k) * p**k * (1 - p) ** (t - k)) <= missed:
        tail, k = tail + own, k - 1
    return k


#: In how many coordinates two sketches' bytes differ: each byte's bits are folded into its lowest one and counted.
FOLDED = "aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, x) -> n + bit_count(({f3}) & 72340172838076673))"


def unlike(a: str, b: str) -> str:
    f1 = "(x | shiftrightunsigned(x, 4))"
    f2 = f"({f1} | shiftrightunsigned({f1}, 2))"
    return FOLDED.format(a=a, b=b, f3=f"{f2} | shiftrightunsigned({f2}, 1)")


def alike(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in ``most`` coordinates or fewer."""
    return with_facts(cut(pairs, "pairs"), sets.select("node", "low")).where(f"{unlike('low_a', 'low_b')} <= {most}").select("a", "b")


def banding(percent: int, missed: float = 1e-8) -> tuple[int, int]:
    """Coordinates and bands with which a pair at ``percent`` shares no bucket with at most that probability."""
    rows = 5 if percent >= 85 else 4
    bands = ceil(log(missed) / log(1 - (percent / 100) ** rows))
    return rows * bands, bands


def near_dedup(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row: documents are linked when at least ``percent``
    hundredths of their shingles' union are common, and of each component the smallest doc_id is kept."""
    with scratch(docs.sparkSession) as kept:
        seen, out = grouped(docs, percent, width, ["doc_id"])
        out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        empty = seen.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        kept.append(cut(out.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near"))
    return kept[0]


def grouped(docs: DataFrame, percent: int, width: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows' sketches, and of the rows with words the columns ``keep`` (doc_id is one), n, component (a row of
    it) and component_id (its smallest doc_id)."""
    t, bands = banding(percent)
    seen = cut(sketched(docs, width, t, bands, keep), "sketches")
    worded = seen.where("n > 0")
    copies = worded.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    copies = cut(copies, "copies")
    # a set that one row has is its own class, map-side; rows of others meet their class in slices
    flagged = likely_in(worded, [F.col("d1"), F.col("d2")], copies, [F.col("d1"), F.col("d2")])
    columns = [*keep, "n", "d1", "d2", "row", "keys"]
    alone = flagged.where("not likely").select(*columns, F.col("row").alias("node"), F.col("doc_id").alias("least"))
    together = flagged.where("likely").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)))
    lead = together.select("d1", "d2", "slice").distinct().join(copies, ["d1", "d2"])
    together = together.join(lead, ["d1", "d2", "slice"], "left").select(*columns, F.coalesce("node", "row").alias("node"), F.expr("if(node is null, doc_id, least)").alias("least"))
    rows = cut(alone.union(together).withColumn("keys", F.when(F.col("row") == F.col("node"), F.col("keys"))), "rows")
    firsts = rows.where("row = node")

    keys = firsts.select("node", F.explode("keys").alias("key"))
    leaders = cut(keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead"), "leaders")
    # most nodes are alone in most of their buckets: those rows go before the second shuffle
    shared = likely_in(keys, [F.col("key")], leaders, [F.col("key")]).where("likely").select("key", "node", F.pmod(F.xxhash64("node"), F.lit(SLICES)).alias("slice"))
    shared = cut(shared, "shared")
    lead = shared.select("key", "slice").distinct().join(leaders, "key")
    members = cut(shared.join(lead, ["key", "slice"]).select("key", "lead", "node"), "members")
    ids = cut(members.select("node").distinct(), "ids")
    nodes = likely_in(firsts.select("node", "doc_id", "n", "d1", "d2"), [F.col("node")], ids, [F.col("node")]).where("likely").drop("likely")
    nodes = cut(nodes.join(checked_broadcast(ids), "node", "left_semi"), "nodes")
    again = rows.where("row != node").select("node", F.col("doc_id").alias("id"))
    again = again.join(nodes.select(F.col("node").alias("of"), "doc_id"), F.expr("node = of and id <=> doc_id"), "left_semi")
    sets = sets_of(docs, nodes, width, t, bands, not again.isEmpty())
    pairs = members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    tried = verified(alike(pairs, sets, most_unlike(t, percent)), sets)
    found = settled(members, nodes, sets, tried, percent, most_unlike(t, percent))

    named = firsts.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("node", "component").join(smallest, "component").select("node", "component", "component_id")
    # copies of one set get its component in slices
    dealt = rows.select(*keep, "n", "row", "node").withColumn("slice", F.when(F.col("row") == F.col("node"), -1).otherwise(F.pmod(F.xxhash64("row"), F.lit(SLICES))))
    each = dealt.select("node", "slice").distinct().join(named, "node")
    return seen, dealt.join(each, ["node", "slice"]).select(*keep, "n", "component", "component_id")


def distinct_groups(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs with all their columns, one document of each group of linked ones: that with the smallest doc_id, and if
    this doc_id stands on several texts of the group, that with the smallest digest. A null doc_id is larger than any
    other. Rows without words stay. Of rows with the chosen doc_id and equal texts all stay (exact dedup is another
    operator's), but without a doc_id they are not known to be one document, and one row stays. Rows are told apart
    by doc_id and text, so what happens to one says nothing of others with its doc_id. A row travels as one struct, so
    its columns may have any names."""
    key = ["id", "sha"]
    sha = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("sha")
    keyed = docs.select(F.col("doc_id").alias("id"), sha, F.struct("*").alias("row"))
    with scratch(docs.sparkSession) as kept:
        rows = cut(grouped(docs.select("doc_id", "text", sha), percent, width, ["doc_id", "sha"])[1].select(F.col("doc_id").alias("id"), "sha", "component", "component_id"), "groups")
        first = rows.where("id <=> component_id")
        several = first.groupBy("component").agg(F.min("sha").alias("lead"), F.max("sha").alias("last")).where("lead < last").select("component", "lead")
        beaten = first.join(checked_broadcast(several), "component").where("sha != lead")
        dropped = cut(rows.where("not (id <=> component_id)").select(*key).union(beaten.select(*key)).distinct(), "dropped")
        again = cut(drop_keys(first.where("id is null").groupBy(*key).count().where("count > 1").select(*key), dropped, key), "again")
        kept += [dropped, again]
    out = drop_keys(keyed, dropped, key)
    if not again.isEmpty():
        out = drop_keys(out, again, key).unionByName(keep_keys(keyed, again, key).dropDuplicates(key))
    return out.select("row.*")


def settled(members: DataFrame, nodes: DataFrame, sets: DataFrame, tried: DataFrame, percent: int, most: int) -> DataFrame:
    """node and component of all linked nodes, once no pair of one bucket is left that could join two components."""
    linked = F.expr(f"100 * common >= {percent} * either")
    links, done = tried.where(linked).select("a", "b"), tried.select("a", "b")
    buckets, shared = members.select("key", "node").join(nodes.select("node", "n"), "node"), None
    for turn in range(LEADER_TURNS + 1):
        found = components(links)
        placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = cut(still_open(placed), "open")
        if shared is None:
            shared = shared_items(sets, placed.select("node").distinct())
            # this drops nodes without any link, so from now on fewer buckets are open
            placed = placed.join(shared, "node").where(f"100 * shared >= {percent} * n")
            placed = cut(still_open(placed), "open")
        buckets = placed.drop("component")
        kinds = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.expr("m * m")).alias("within"))
        rows, pairs = kinds.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum(F.expr("(all * all - within) div 2")), F.lit(0))).first()
        if not pairs:
            return found
        last = turn == LEADER_TURNS or pairs <= PAIRS_A_NODE * rows
        open_pairs = cut((all_pairs(placed, percent) if last else leader_pairs(placed, percent, turn)).join(done, ["a", "b"], "left_anti"), "pairs")
        more = verified(alike(open_pairs, sets, most), sets)
        links, done = links.union(more.where(linked).select("a", "b")), done.union(open_pairs.select("a", "b"))
        if last:
            return components(links)
    raise AssertionError("the last turn returns")


def still_open(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold nodes of several components."""
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return placed.join(split, "key", "left_semi")


def shared_items(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, how many of its items another one of the nodes has too, and their counts in hashed bins."""
    own_sets = sets.join(nodes, "node", "left_semi")
    items = own_sets.select("node", F.explode("items").alias("item"))
    alone = items.groupBy("item").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("node")).where("m = 1")
    alone = alone.groupBy("node").agg(F.collect_list("item").alias("alone"))  # at most the node's own set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.bincount(np.array(x, np.int64) & 63, minlength=64) - np.bincount(np.array(y or [], np.int64) & 63, minlength=64) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [batch.column(0), pa.array([int(x.sum()) for x in bins], pa.int64()), pa.array([x.tolist() for x in bins], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "shared", "bins"])

    return cut(own_sets.join(alone, "node", "left").select("node", "items", "alone").mapInArrow(run, "node long, shared long, bins array<int>"), "shared")


#: Whether two open nodes can be linked: first by the smaller total, then bin by bin.
FITS = "100 * least({a}.shared, {b}.shared) >= {percent} * ({a}.n + {b}.n - least({a}.shared, {b}.shared)) and aggregate(zip_with({a}.bins, {b}.bins, (x, y) -> least(x, y)), 0, (s, x) -> s + x) * (100 + {percent}) >= {percent} * ({a}.n + {b}.n)"


def leader_pairs(placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each open bucket's next leader with the bucket's nodes of other components: first the node with the fewest
    items of its own, then one by a hash of the turn."""
    rank = F.struct((F.col("n") - F.col("shared") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("rank"), "node", "component", "n", "shared", "bins")
    leaders = placed.groupBy("key").agg(F.min(rank).alias("lead"))
    both = placed.alias("x").join(leaders, "key").where("x.component != lead.component").where(FITS.format(a="x", b="lead", percent=percent)).select("x.node", "lead")
    return both.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def all_pairs(placed: DataFrame, percent: int) -> DataFrame:
    a, b = placed.alias("a"), placed.alias("b")
    fits = f"a.key = b.key and a.node < b.node and a.component != b.component and {FITS.format(a='a', b='b', percent=percent)}"
    return a.join(b, F.expr(fits)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
