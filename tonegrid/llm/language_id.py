"""Language ID by cross-parsing entropy.

Each language has a reference: a bounded sample of labelled text. A suffix automaton of it gives the longest match at
any place, so a text is parsed, left to right, into the longest phrases that the reference has. Phrases times the
bits that name a place in the reference, divided by the letters and spaces parsed, is the cross entropy; the language
with the smallest wins (ties: the first by code point). Score: 2 to the minus bits, as a share over the languages.

Texts are lower-cased, and runs of anything but letters become one space. Whole texts are parsed, in blocks of fixed
length side by side, each as if a phrase began there; where one goes on from the block before, the parse is put right
from the block's start up to where both agree, mostly after a few phrases. So blocks leave no trace in the counts.
Every letter of a reference is a symbol of its own, whatever the alphabets.

What bounds the references, as parameters of ``fit``: ``total_chars`` are shared out evenly, so of n languages each has
at most min(``language_chars``, ``total_chars`` / n) characters (40,000 for up to 6, 7,500 for 32, 240 for 1,000), in
pieces of ``row_chars`` from different rows. With many languages, or with letters by the thousand, a reference shows only
part of what its language uses; give more characters then (a worker holds about 1 KB a character).

Nulls: a null text, or one without a letter, is ``und`` with score 0, and so is all if nothing was learned. Rows with
a null lang teach nothing. Rows are judged one by one, so repeated rows get equal results. An empty table gives an
empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, map_text

#: Symbols of a block; columns of the table of frequent letters' transitions, those of other letters are searched for.
BLOCK, SYMBOLS = 1024, 120
NEW = 1 << 30


@dataclass(frozen=True)
class References:
    texts: dict[str, str]


def fit(docs: DataFrame, languages: int = 1000, total_chars: int = 240_000, language_chars: int = 40_000, row_chars: int = 200) -> References:
    """References from docs' text and lang: of at most ``languages`` languages (those with most rows), rows in the
    order of a hash of doc_id, and of each a stretch of ``row_chars`` characters at a hashed place."""
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"), "doc_id")
    common = [r["lang"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    if not common:
        return References({})
    chars = min(language_chars, total_chars // len(common))
    rows = max(1, chars // row_chars)
    h = F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.length("text") - row_chars)
    pieces = known.withColumn("h", h).select("lang", "h", F.substring("text", (place + 1).cast("int"), F.lit(row_chars)).alias("piece"))
    first = Window.partitionBy("lang").orderBy("h", "piece")
    found = pieces.where(F.col("lang").isin(common)).withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows).select("lang", "k", "piece").collect()
    texts: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["k"])):
        texts.setdefault(r["lang"], []).append(r["piece"])
    return References({k: " ".join(v) for k, v in texts.items()})


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return go


class Parser:
    """All languages' automata in one table: a state's row holds, for each symbol, the next state's row and whether a
    phrase begins. Symbol 0 is the space, then come the references' most frequent letters, one symbol for letters that
    no reference has, and one that fills blocks up. Symbols past these are the references' other letters: rare ones,
    or those of large alphabets. Few states have transitions by them, so these are kept as sorted keys instead."""

    def __init__(self, refs: References) -> None:
        self.names = sorted(refs.texts)
        cleaned = {k: "".join(c if c.isalpha() else " " for c in t.lower()).split() for k, t in refs.texts.items()}
        cleaned = {k: " ".join(v) for k, v in cleaned.items()}
        letters = [c for c, _ in Counter("".join(cleaned.values())).most_common() if c != " "]
        letters, others = letters[: SYMBOLS - 2], letters[SYMBOLS - 2 :]
        self.size, self.others = len(letters) + 3, len(others)
        self.place = np.zeros(0x110000, np.min_scalar_type(self.size + self.others))
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                self.place[i] = self.size - 2
        for i, c in enumerate(letters, 1):
            self.place[ord(c)] = i
        for i, c in enumerate(others, self.size):
            self.place[ord(c)] = i
        tables, keys, nexts, self.roots, base = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], 0
        self.bits = np.array([np.log2(max(2, len(cleaned[k]))) for k in self.names])
        for k in self.names:
            go = automaton(self.place[np.frombuffer(cleaned[k].encode("utf-32-le"), np.uint32)].tolist())
            at = np.array([(s, c, t) for s, own in enumerate(go) for c, t in own.items()], np.int64).reshape(-1, 3)
            other = at[:, 1] >= self.size
            keys.append((at[other, 0] + base) * self.others + at[other, 1] - self.size)
            nexts.append((at[other, 2] + base) * self.size | np.where(at[other, 0] == 0, NEW, 0))
            at = at[~other]
            table = np.full((len(go), self.size), -1, np.int64)
            table[at[:, 0], at[:, 1]] = (at[:, 2] + base) * self.size
            start = np.where(table[0] < 0, base * self.size, table[0]) | NEW  # a symbol that the reference lacks is a phrase
            table = np.where(table < 0, start, table)
            table[0] = start
            table[:, -1] = base * self.size
            tables.append(table.astype(np.int32).ravel())
            self.roots.append(base * self.size)
            base += len(go)
            if base * self.size >= NEW:
                raise ValueError(f"the references' automata take {base * self.size} table cells; {NEW} is the most")
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)
        keys, nexts = np.concatenate(keys), np.concatenate(nexts)
        order = np.argsort(keys)
        self.keys, self.nexts = keys[order], nexts[order].astype(np.int32)

    def search(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states (rows) have a transition by other letters' symbols, and the transitions."""
        key = state.astype(np.int64) // self.size * self.others + symbol - self.size
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.nexts[at]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What the table would hold for states (a column for each language) and other letters' symbols (rows)."""
        roots = np.array(self.roots, np.int32)
        known, found = self.search(state, symbol[:, None])
        begins, start = self.search(roots, symbol[:, None])
        return np.where(known, found, np.where(begins, start, roots | NEW))

    def symbols(self, text: bytes | None) -> np.ndarray:
        s = self.place[np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), np.uint32)]
        return s[(s > 0) | np.append(False, s[:-1] > 0)]  # the first space of a run stays

    def follow(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Transitions of single states by symbols under languages."""
        found = self.table.take(state + np.minimum(symbol, self.size - 1))
        if self.others and len(rare := np.flatnonzero(symbol >= self.size)):
            roots = np.array(self.roots, np.int32)[lang[rare]]
            (known, there), (begins, start) = self.search(state[rare], symbol[rare]), self.search(roots, symbol[rare])
            found[rare] = np.where(known, there, np.where(begins, start, roots | NEW))
        return found

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) under each language (column)."""
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // BLOCK) for t in texts])
        blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        grid = np.full((len(blocks), BLOCK), self.size - 1, self.place.dtype)
        for i, k in enumerate(order):
            grid[i, : len(blocks[k])] = blocks[k]
        lengths = np.array([len(blocks[k]) for k in order])
        live = np.searchsorted(-lengths, -np.arange(BLOCK), side="left")  # blocks longer than each step
        grid = np.ascontiguousarray(grid.T).astype(np.int32)
        state = np.tile(np.array(self.roots, np.int32), (len(blocks), 1))
        count = np.zeros(state.shape, np.int32)
        for k in range(BLOCK):
            if not (n := live[k]):
                break
            found = self.table.take(state[:n] + np.minimum(grid[k, :n, None], self.size - 1))
            if self.others and len(rare := np.flatnonzero(grid[k, :n] >= self.size)):
                found[rare] = self.step(state[rare], grid[k, rare])
            count[:n] += found >> 30
            state[:n] = found & (NEW - 1)
        self.joined(owner, order, lengths, grid, state, count)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        np.add.at(out, owner[order], count)
        return out

    def joined(self, owner: np.ndarray, order: np.ndarray, lengths: np.ndarray, grid: np.ndarray, end: np.ndarray, count: np.ndarray) -> None:
        """Puts counts right for blocks that go on from the one before: the parse from there and the one counted run side
        by side until they agree. One that doesn't up to the block's end changes what the next block goes on from."""
        after = np.full(len(order), -1)  # the place of the text's next block
        place = np.argsort(order)
        goes_on = np.flatnonzero(owner[1:] == owner[:-1])
        after[place[goes_on]] = place[goes_on + 1]
        langs = np.arange(len(self.names))
        row, lang = np.repeat(after[place[goes_on]], len(langs)), np.tile(langs, len(goes_on))
        old, new = np.array(self.roots, np.int32)[lang], end[np.repeat(place[goes_on], len(langs)), lang]
        while len(row):
            left = []
            for k in range(BLOCK):
                symbol = grid[k, row]
                was, now = self.follow(old, symbol, lang), self.follow(new, symbol, lang)
                count[row, lang] += (now >> 30) - (was >> 30)
                old, new = was & (NEW - 1), now & (NEW - 1)
                apart, ends = old != new, lengths[row] == k + 1
                if (over := np.flatnonzero(apart & ends)).size:
                    left.append((row[over], lang[over], old[over], new[over]))
                on = np.flatnonzero(apart & ~ends)
                row, lang, old, new = row[on], lang[on], old[on], new[on]
                if not len(row):
                    break
            if not left:
                return
            row, lang, old, new = map(np.concatenate, zip(*left))
            row = after[row]
            on = np.flatnonzero(row >= 0)
            row, lang, old, new = row[on], lang[on], old[on], new[on]


def predict(docs: DataFrame, refs: References) -> DataFrame:
    """doc_id, lang_pred and score for each row."""

    def make() -> Callable:
        parser = held(("languages", *sorted(refs.texts.items())), lambda: Parser(refs))

        def work(texts: list) -> list:
            symbols = [parser.symbols(t) for t in texts]
            letters = np.array([int((s > 0).sum()) for s in symbols])
            if not parser.names:
                return [["und"] * len(texts), [0.0] * len(texts)]
            bits = parser.phrases(symbols) * parser.bits / np.maximum(1, [[len(s)] for s in symbols])
            best = bits.argmin(1)
            share = 2.0 ** (bits.min(1, keepdims=True) - bits)
            score = np.where(letters > 0, 1 / share.sum(1), 0.0)
            return [[parser.names[b] if n else "und" for b, n in zip(best, letters)], score]

        return work

    return map_text(docs, "text", ["doc_id"], "lang_pred string, score double", make)
