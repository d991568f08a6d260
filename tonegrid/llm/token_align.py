"""Alignment of two tokenizers' tokens on the bytes of texts, by fragments that compose.

Both tokenizers encode a space and the text; a token covers the bytes it stands for. Bytes at which tokens of both end
cut the tokens into groups, and two tokens are linked when their byte ranges overlap. Links never cross a cut, and each
stretch between neighbouring token ends, of either tokenizer, is the overlap of exactly one link.

What lies in a range of a text's bytes is a fragment: the tokens up to the first cut (open prefix), the closed groups
with their links, the tokens after the last cut (open suffix). Fragments compose: a suffix and the next prefix make one
group. That is associative, with the empty fragment as unit, so fragments of neighbouring ranges can be composed in any
tree. Texts up to ``SPAN`` characters are a fragment each, worked on in slices of many texts. A longer text is dealt over
tasks in spans that begin at a space between two other characters, where no token of either tokenizer goes across; the
spans' fragments then meet in a tree, ``FAN`` at a time.

How many documents hold a pair of ids linked is counted over all of them. Pairs that most documents have are told apart
by levels of counts; at most ``FREQUENT`` of them go to tasks, and links of rarer pairs meet their counts by a shuffle.

Nulls: a null or empty text has no tokens, and so has one whose tokens' bytes are not the space and the text (as where
it holds a character that a tokenizer takes for a space). A null doc_id stays null. Repeated rows count each time. Texts
are encoded whole, whatever their length; special tokens' strings are plain text. An empty table gives an empty result.
Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, held, scratch, slices
from .pieces import MARK, Vocabulary

#: Characters of a span of a long text, and fragments that are composed at a time.
SPAN, FAN = 1 << 17, 16
#: Pairs of ids whose counts go to tasks at most.
FREQUENT = 200_000
#: Where a text may be cut: before a space between characters that are neither white space nor the mark.
SAFE = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")
EMPTY = np.empty(0, np.int64)


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level BPE tokenizer: its tokens' bytes with their ids, and the pattern that splits texts."""

    ids: dict[bytes, int] = field(repr=False)
    pattern: str = field(repr=False)
    name: str

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteLevel:
        """Reads the vocabulary and the merges, on the driver. Merges have to be in the order of the ids they make."""
        with open(path, "rb") as f:
            raw = f.read()
        model = json.loads(raw)
        special = {t["id"] for t in model["added_tokens"]}
        # bytes that print stand for themselves, the others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        made = [model["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or len(made) + 256 != len(ids):
            raise ValueError("the merges are not in the order of their ids")
        return cls(ids, pattern, hashlib.sha256(raw + pattern.encode()).hexdigest())

    def build(self) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
        import tiktoken

        texts = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            texts[i] = token
        own = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ids, special_tokens={}).encode_ordinary
        return lambda spaced: [own(x) for x in spaced], texts


@dataclass(frozen=True)
class PieceModel:
    """A SentencePiece model that puts a mark before a text; the model's bytes go to tasks."""

    raw: bytes = field(repr=False)
    vocabulary: Vocabulary = field(repr=False)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read(), Vocabulary.load(path))

    @property
    def name(self) -> str:
        return self.vocabulary.name

    def build(self) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=self.raw)
        return lambda spaced: own.encode([x[1:] for x in spaced], num_threads=1), self.vocabulary.texts


@dataclass
class Tokens:
    """Ids of consecutive tokens and the byte each ends at."""

    ids: np.ndarray = field(default_factory=lambda: EMPTY)
    lengths: np.ndarray = field(default_factory=lambda: EMPTY)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate([self.ids, other.ids]), np.concatenate([self.lengths, other.lengths]))

    def __getitem__(self, which: slice) -> Tokens:
        return Tokens(self.ids[which], self.lengths[which])

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Closed:
    """Whole groups of tokens: how many, their text, and their links as distinct pairs with how often each stands."""

    n: int = 0
    text: str = ""
    pairs: np.ndarray = field(default_factory=lambda: EMPTY)
    times: np.ndarray = field(default_factory=lambda: EMPTY)

    def __add__(self, other: Closed) -> Closed:
        pairs, at = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.bincount(at, np.concatenate([self.times, other.times]), len(pairs)).astype(np.int64)
        return Closed(self.n + other.n, ";".join(x for x in (self.text, other.text) if x), pairs, times)


@dataclass
class Fragment:
    """What a range of bytes holds. Without a cut all its tokens are in the prefix."""

    prefix: tuple[Tokens, Tokens] = field(default_factory=lambda: (Tokens(), Tokens()))
    has_cut: bool = False
    closed: Closed = field(default_factory=Closed)
    suffix: tuple[Tokens, Tokens] = field(default_factory=lambda: (Tokens(), Tokens()))


class Aligner:
    """Groups and links of a pair of tokenizers; a pair of ids is the number a * (B's size) + b."""

    def __init__(self, first: ByteLevel, second: PieceModel) -> None:
        (self.encode_a, self.texts_a), (self.encode_b, self.texts_b) = first.build(), second.build()
        self.size_b = len(self.texts_b)
        self.pairs = len(self.texts_a) * self.size_b
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in x], np.int64) for x in (self.texts_a, self.texts_b))
        self.written = [f"{i}{end}" for i in range(max(len(self.texts_a), self.size_b)) for end in ",|;"]

    def tokens(self, spaced: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both tokenizers for each string that begins with a space; None where their bytes are not the string's."""
        out = []
        for text, a, b in zip(spaced, self.encode_a(spaced), self.encode_b(spaced)):
            raw = text.encode()
            same = b"".join(map(self.texts_a.__getitem__, a)) == raw and b"".join(map(self.texts_b.__getitem__, b)) == raw
            out.append((a, b) if same else None)
        return out

    def groups(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """For the bytes up to each of ``edges``, which are cuts: numbers of groups and of links, the groups' text,
        distinct pairs and how often each stands."""
        stretches = np.unique(np.concatenate([ends_a, ends_b]))
        at_a, at_b = np.searchsorted(ends_a, stretches), np.searchsorted(ends_b, stretches)
        of = np.searchsorted(edges, stretches)
        cuts = stretches[(ends_a[at_a] == stretches) & (ends_b[at_b] == stretches)]
        n_groups = np.bincount(np.searchsorted(edges, cuts), minlength=len(edges))
        n_links = np.bincount(of, minlength=len(edges))
        keys = np.sort(of * self.pairs + a[at_a] * self.size_b + b[at_b])
        firsts = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(firsts, append=len(keys))
        pairs = keys[firsts] % self.pairs
        pair_ends = np.searchsorted(keys[firsts] // self.pairs, np.arange(len(edges) + 1))
        # ids in the order they are written: of each group A's, then B's
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a * 3 + np.diff(group_a, append=-1).astype(bool)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b * 3 + 2 * np.diff(group_b, append=-1).astype(bool)
        ends = np.searchsorted(ends_a, edges, side="right") + np.searchsorted(ends_b, edges, side="right")
        start = 0
        for i, end in enumerate(ends.tolist()):
            p, q = pair_ends[i], pair_ends[i + 1]
            yield int(n_groups[i]), int(n_links[i]), "".join(map(self.written.__getitem__, order[start:end].tolist()))[:-1], pairs[p:q], times[p:q]
            start = end

    def closed(self, a: Tokens, b: Tokens) -> Closed:
        """Tokens of both over the same bytes."""
        if not len(a) and not len(b):
            return Closed()
        ends_a, ends_b = a.lengths.cumsum(), b.lengths.cumsum()
        n, _, text, pairs, times = next(self.groups(a.ids, b.ids, ends_a, ends_b, ends_a[-1:]))
        return Closed(n, text, pairs, times)

    def fragment(self, a: Tokens, b: Tokens, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
        """Of the tokens that end in a range, and the bytes of the text they end at."""
        common = np.intersect1d(ends_a, ends_b)
        if not len(common):
            return Fragment((a, b))
        (a1, a2), (b1, b2) = (np.searchsorted(e, common[[0, -1]], side="right") for e in (ends_a, ends_b))
        return Fragment((a[:a1], b[:b1]), True, self.closed(a[a1:a2], b[b1:b2]), (a[a2:], b[b2:]))

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        join = lambda p, q: (p[0] + q[0], p[1] + q[1])
        if not x.has_cut:
            return Fragment(join(x.prefix, y.prefix), y.has_cut, y.closed, y.suffix)
        if not y.has_cut:
            return Fragment(x.prefix, True, x.closed, join(x.suffix, y.prefix))
        return Fragment(x.prefix, True, x.closed + self.closed(*join(x.suffix, y.prefix)) + y.closed, y.suffix)

    def whole(self, x: Fragment) -> Closed:
        """A whole text's groups: its begin and its end are cuts."""
        return self.closed(*x.prefix) + x.closed + self.closed(*x.suffix)

    def texts(self, spaced: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, the groups' digest, pairs and times of each string; of empty ones none."""
        out = [(0, 0, 0, 0, "", EMPTY, EMPTY)] * len(spaced)
        some = [i for i, x in enumerate(spaced) if x]
        found = [(i, *x) for i, x in zip(some, self.tokens([spaced[i] for i in some])) if x]
        if found:
            a, b = (np.concatenate([np.array(x[k], np.int64) for x in found]) for k in (1, 2))
            ends_a, ends_b = self.lengths_a[a].cumsum(), self.lengths_b[b].cumsum()
            edges = ends_a[np.cumsum([len(x[1]) for x in found]) - 1]
            for (i, own_a, own_b), (n, links, text, pairs, times) in zip(found, self.groups(a, b, ends_a, ends_b, edges)):
                out[i] = (len(own_a), len(own_b), n, links, hashlib.sha256(text.encode()).hexdigest(), pairs, times)
        return out


def spans(text: str, most: int) -> list[str]:
    """The text, after a space, in pieces of about ``most`` characters that each begin with a space."""
    spaced, out, at = " " + text, [], 0
    while at < len(spaced):
        found = SAFE.search(spaced, at + most)
        end = found.start() if found else len(spaced)
        out.append(spaced[at:end])
        at = end
    return out


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
PARTS = "head_a array<long>, head_a_len array<long>, head_b array<long>, head_b_len array<long>, tail_a array<long>, tail_a_len array<long>, tail_b array<long>, tail_b_len array<long>"
FRAGMENT = f"row long, doc_id long, part long, valid boolean, n_a long, n_b long, has_cut boolean, n_groups long, groups string, pairs array<long>, times array<long>, {PARTS}"
SIDES = [f"{side}_{which}" for side in ("head", "tail") for which in "ab"]


def fragment_row(row: dict, x: Fragment) -> dict:
    own = {"has_cut": x.has_cut, "n_groups": x.closed.n, "groups": x.closed.text, "pairs": x.closed.pairs, "times": x.closed.times}
    for name, t in zip(SIDES, (*x.prefix, *x.suffix)):
        own |= {name: t.ids, f"{name}_len": t.lengths}
    return row | own


def fragment_of(r: dict) -> Fragment:
    whole = lambda x: np.array(x, np.int64)
    sides = [Tokens(whole(r[name]), whole(r[f"{name}_len"])) for name in SIDES]
    return Fragment((sides[0], sides[1]), r["has_cut"], Closed(r["n_groups"], r["groups"], whole(r["pairs"]), whole(r["times"])), (sides[2], sides[3]))


def columns(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def align(docs: DataFrame, first: ByteLevel, second: PieceModel, span: int = SPAN) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times for each row, read from written tables."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    firsts = f"row long, doc_id long, part long, span string, {FOUND}"
    first_schema, fragment_schema, found_schema = arrow(firsts), arrow(FRAGMENT), arrow(f"row long, doc_id long, {FOUND}")
    aligner = lambda: held(("align", first.name, second.name), lambda: Aligner(first, second))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one span are done; of longer ones the spans go on."""
        own = aligner()
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).fill_null(0).to_pylist()
            for a, b in slices(sizes, SLICE_BYTES):
                rows, ids, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in range(3))
                done = own.texts([" " + t if t and len(t) <= span else "" for t in texts])
                out = []
                for row, i, t, x in zip(rows, ids, texts, done):
                    none = dict.fromkeys(first_schema.names) | {"row": row, "doc_id": i}
                    if t and len(t) > span:
                        out += [none | {"part": k, "span": s} for k, s in enumerate(spans(t, span))]
                    else:
                        out.append(none | dict(zip(first_schema.names[4:], x)))
                yield columns(out, first_schema)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner()
        for batch in batches:
            for i in range(batch.num_rows):  # spans are long, so one at a time
                r = batch.slice(i, 1).to_pylist()[0]
                found = own.tokens([r["span"]])[0]
                a, b = (np.array(x, np.int64) for x in found or ((), ()))
                a, b = Tokens(a, own.lengths_a[a]), Tokens(b, own.lengths_b[b])
                base = {"row": r["row"], "doc_id": r["doc_id"], "part": r["part"], "valid": found is not None, "n_a": len(a), "n_b": len(b)}
                yield columns([fragment_row(base, own.fragment(a, b, a.lengths.cumsum(), b.lengths.cumsum()))], fragment_schema)

    def composed(group: pa.Table) -> pa.Table:
        own, rows = aligner(), group.sort_by("part").to_pylist()
        out = fragment_of(rows[0])
        for r in rows[1:]:
            out = own.compose(out, fragment_of(r))
        base = {"row": rows[0]["row"], "doc_id": rows[0]["doc_id"], "part": rows[0]["part"] // FAN, "valid": all(r["valid"] for r in rows)}
        base |= {n: sum(r[n] for r in rows) for n in ("n_a", "n_b")}
        return pa.Table.from_batches([columns([fragment_row(base, out)], fragment_schema)])

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner()
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                x = own.whole(fragment_of(r)) if r["valid"] else Closed()
                n = (r["n_a"], r["n_b"]) if r["valid"] else (0, 0)
                found = (*n, x.n, int(x.times.sum()), hashlib.sha256(x.text.encode()).hexdigest() if r["valid"] else "", x.pairs, x.times)
                yield columns([dict(zip(found_schema.names, (r["row"], r["doc_id"], *found)))], found_schema)

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut(given.mapInArrow(short, firsts), "aligned")
    out = seen.where("part is null").drop("part", "span")
    deepest = seen.agg(F.max("part")).first()[0]
    if deepest is None:
        return out
    parts = seen.where("part is not null").select("row", "doc_id", "part", "span").repartition("row", "part")
    parts = cut(parts.mapInArrow(fragments, FRAGMENT), "fragments")
    while deepest:
        parts = cut(parts.groupBy("row", F.expr(f"part div {FAN}").alias("next")).applyInArrow(composed, FRAGMENT), "fragments")
        deepest //= FAN
    return out.union(cut(parts.mapInArrow(done, f"row long, doc_id long, {FOUND}"), "aligned"))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best: whether no pair of its A id has more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts")
    most = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("most"))  # at most A's vocabulary
    return counts.join(F.broadcast(most), F.expr(f"pair div {size_b} = a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, first: ByteLevel, second: PieceModel, span: int = SPAN, frequent: int = FREQUENT) -> DataFrame:
    """For each row doc_id, n_a, n_b, n_groups, n_links, n_best (links of a pair that is best for its A id), count_sum
    (of the links' pairs' counts) and groups_sha256, the digest of ids as ``a1,a2|b1;a3|b2,b3``."""
    spark = docs.sparkSession
    with scratch(spark) as kept:
        aligned = align(docs, first, second, span)
        marked = cut(pair_counts(aligned, len(second.vocabulary.texts)).withColumn("level", F.floor(F.log2("n")).cast("int")), "marked")
        least, total = 63, 0
        for level, n in sorted(((r.level, r.n) for r in marked.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
            if (total := total + n) > frequent:
                break
            least = level
        known = marked.where(F.col("level") >= least).select("pair", "n", "best").orderBy("pair").toArrow()
        known = spark.sparkContext.broadcast([known.column(i).to_numpy() for i in range(3)])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, counts, best = known.value
            for batch in batches:
                lists = batch.column(1)
                own, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
                of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], of[hit], times[hit] * best[at[hit]])
                np.add.at(sums[1], of[hit], times[hit] * counts[at[hit]])
                ends = pa.array(np.searchsorted(of[~hit], np.arange(batch.num_rows + 1)), pa.int32())
                rest = [pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (own, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), *rest], names=["row", "n_best", "count_sum", "pairs", "times"])

        first_sums = cut(aligned.select("row", "pairs", "times").mapInArrow(counted, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "sums")
        rest = first_sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        rest = rest.join(marked.where(F.col("level") < least).select("pair", "n", "best"), "pair")
        rest = rest.groupBy("row").agg(F.sum(F.expr("if(best, times, 0)")).alias("more_best"), F.sum(F.expr("times * n")).alias("more_sum"))
        sums = first_sums.select("row", "n_best", "count_sum").join(rest, "row", "left")
        sums = sums.select("row", F.expr("n_best + coalesce(more_best, 0)").alias("n_best"), F.expr("count_sum + coalesce(more_sum, 0)").alias("count_sum"))
        base = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        kept.append(cut(base.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment"))
    return kept[0]
