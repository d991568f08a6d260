"""Quality rules: base counts, and how far a document's histograms are from those of the corpus's languages.

References: for each language, the mean histogram of character classes and that of its most common words, over all
documents that name the language. A document's Jensen-Shannon distance (0 to 1, base 2) is that to the nearest
reference, whatever language it names itself. It is rejected when a distance is over its limit, unless it is too
short for that histogram to say anything. A document that names a language without a reference (there are references
for a bounded number of languages) has nothing to be compared with, so the base rule alone decides.

Nulls: a null text has no words, so its base rule fails; a null lang counts towards no reference. Empty texts and
texts of white space are as null. With no reference at all only the base rule decides. Rows are judged one by one,
so repeated rows get equal results. An empty table gives an empty result. Extra columns are not looked at, and a table
without a lang is as one where lang is null.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, held, map_text, quoted, unused

SYMBOLS = b"#*$%&|<>"
#: Character classes: white space, small letter, capital, digit, sentence mark, symbol, beyond ASCII, other.
N_CLASSES = 8


def class_table() -> np.ndarray:
    """Class of each UTF-8 byte; N_CLASSES for bytes that continue a character."""
    table = np.full(256, 7, np.int64)
    table[list(b"\t\n\v\f\r ")] = 0
    table[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
    table[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
    table[list(b"0123456789")] = 3
    table[list(b".,;:!?'\"()-")] = 4
    table[list(b"#*$%&|<>@[]\\^_`{}~/+=")] = 5
    table[0xC0:] = 6
    table[0x80:0xC0] = N_CLASSES
    return table


@dataclass(frozen=True)
class References:
    """For each language: shares of the character classes, its common words and their shares, then that of all others;
    and its name (no names at all: every document is compared)."""

    classes: np.ndarray
    words: list[list[bytes]]
    shares: list[np.ndarray]
    langs: list[str] = field(default_factory=list)


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple[str | None, bytes]]:
    """lang and text (UTF-8 bytes) of each row; of a batch, few rows at a time become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            part = batch.slice(i, at_once)
            yield from zip(part.column(0).to_pylist(), (t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()))


def summaries(batches: Iterator[pa.RecordBatch], counters: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Of one task, for each language at most ``counters`` words (Misra-Gries) that may be common. Summaries add up, so
    a task that holds ``most`` counters, of however many languages, hands them on and starts anew."""
    names, types = ["lang", "word", "least"], (pa.string(), pa.binary(), pa.int64())

    def handed_on(found: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, own in found.items() for w, n in pruned(own, counters).items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    found, total = {}, 0
    for lang, text in rows_of(batches):
        own = found.setdefault(lang, Counter())
        total -= len(own)
        own.update(text.split())
        if len(own) > 16 * counters:
            found[lang] = own = pruned(own, counters)
        total += len(own)
        if total > most:
            yield handed_on(found)
            found, total = {}, 0
    yield handed_on(found)


def pruned(counts: Counter, counters: int) -> Counter:
    if len(counts) <= counters:
        return counts
    less = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - less for k, n in counts.items() if n > less})


def counted(batches: Iterator[pa.RecordBatch], likely: dict[str, set]) -> Iterator[pa.RecordBatch]:
    """Of one task, for each language with likely words: its documents' shares of the likely words, of all words (key ``w``) and of the
    character classes (``c0`` ...), in millionths, summed. A long document counts as much as a short one, and whole
    numbers add up alike in any order."""
    table, totals = class_table(), {}
    for lang, text in rows_of(batches):
        if (mine := likely.get(lang)) is None:
            continue
        words, own = Counter(text.split()), totals.setdefault(lang, Counter())
        if not words:
            continue
        n = words.total()
        own[b"w"] += 1_000_000
        for w in words.keys() & mine:
            own[b"=" + w] += words[w] * 1_000_000 // n
        kinds = np.bincount(table[np.frombuffer(text, np.uint8)], minlength=N_CLASSES)[:N_CLASSES]
        for k, share in enumerate((kinds * 1_000_000 // kinds.sum()).tolist()):
            own[b"c%d" % k] += share
    rows = [(lang, k, n) for lang, own in totals.items() for k, n in own.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64()))], names=["lang", "key", "n"])


def references(docs: DataFrame, top: int = 32, counters: int = 4096, languages: int = 1000) -> References:
    """References of at most ``languages`` languages (those with most words), of ``top`` words each, so that what
    the driver gets has a fixed bound: 2 * top words and their sums, and N_CLASSES + 1 more, for each. Candidates for the
    common words, the 2 * top that occur most, come from mergeable summaries that hold
    every word with over 2 / counters of a language's words; their shares are exact and cover all documents."""
    if "lang" not in docs.columns:
        return References(np.empty((0, N_CLASSES)), [], [], [])  # as where every lang is null
    texts = docs.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    found = texts.mapInArrow(lambda it: summaries(it, counters), "lang string, word binary, least long").groupBy("lang", "word").agg(F.sum("least").alias("least"))
    found = cut(found, "summaries")  # texts are summarised once
    heavy = found.groupBy("lang").agg(F.sum("least").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    first = Window.partitionBy("lang").orderBy(F.desc("least"), "word")
    likely: dict[str, set] = {}
    for lang, word in found.join(F.broadcast(heavy), "lang").withColumn("k", F.row_number().over(first)).where(F.col("k") <= 2 * top).select("lang", "word").collect():
        likely.setdefault(lang, set()).add(bytes(word))
    forget(found)
    exact = texts.mapInArrow(lambda it: counted(it, likely), "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts: dict[str, dict] = {}
    for lang, key, n in exact.collect():
        counts.setdefault(lang, {})[bytes(key)] = n
    classes, words, shares, langs = [], [], [], []
    for lang, own in sorted(counts.items()):
        c = np.array([own.get(b"c%d" % k, 0) for k in range(N_CLASSES)], float)
        best = sorted(((-n, k) for k, n in own.items() if k[:1] == b"="))[:top]
        w = np.array([-n for n, _ in best] + [own[b"w"] + sum(n for n, _ in best)], float)
        if c.sum() and w.sum():
            classes.append(c / c.sum())
            words.append([k[1:] for _, k in best])
            shares.append(w / w.sum())
            langs.append(lang)
    return References(np.array(classes).reshape(-1, N_CLASSES), words, shares, langs)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances between the distributions along the last axis, 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0).sum(-1), np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def repeated_words(words: list[bytes], width: int) -> int:
    """Words inside a window of ``width`` words (a power of 2) that is found at least twice."""
    if len(words) <= width:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(index) == len(words):
        return 0
    ids, span = np.fromiter(map(index.__getitem__, words), np.int64, len(words)), 1
    while span < width:  # a window of 2n words is the pair of two of n
        pairs = ids[:-span] * (ids.max() + 1) + ids[span:]
        kinds, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(kinds) == len(pairs):
            return 0
        span *= 2
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[ids] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def judge(refs: References, class_limit: float, word_limit: float, min_chars: int, min_words: int) -> Callable:
    def tables() -> tuple:
        place = {w: i for i, w in enumerate(dict.fromkeys(w for own in refs.words for w in own))}
        columns = [np.array([place[w] for w in own], int) for own in refs.words]
        return class_table(), place, columns, frozenset(refs.langs) or None

    def make() -> Callable:
        table, place, columns, known = held(("rules", pickle.dumps(refs)), tables)

        def one(text: bytes | None, lang: str | None) -> tuple:
            text = text or b""
            words = text.split()
            kinds = np.bincount(table[np.frombuffer(text, np.uint8)], minlength=N_CLASSES + 1)
            n, seen, again = len(words), set(), 0
            if b"\n" in text:
                for line in text.split(b"\n"):
                    if line in seen:
                        again += bool(line.strip())
                    seen.add(line)
            repeat = repeated_words(words, 8)
            # white space is one byte a character; every other byte that starts a character is in a word
            row = (n, int(kinds[1:N_CLASSES].sum()), len(text) - len(text.translate(None, SYMBOLS)), again, repeat)
            failed = n < 20 or 100 * repeat > 30 * n
            by_class = by_word = None
            chars = kinds[:N_CLASSES].sum()
            compared = columns and (lang is None or known is None or lang in known)
            if compared and chars >= min_chars:
                by_class = float(jensen_shannon(kinds[:N_CLASSES] / chars, refs.classes).min())
            if compared and n >= min_words:
                counts = Counter(words)
                own = np.array([counts.get(w, 0) for w in place], float)
                by_word = min(float(jensen_shannon(np.append(own[c], n - own[c].sum()) / n, s)) for c, s in zip(columns, refs.shares))
            fits = not (by_class is not None and by_class > class_limit or by_word is not None and by_word > word_limit)
            return *row, failed, by_class, by_word, fits and not failed

        return lambda texts, langs: list(zip(*map(one, texts, langs)))

    return make


def quality_rules(
    docs: DataFrame, keep: list[str] | None = None, refs: References | None = None, text: str = "text", lang: str | None = "lang", class_limit: float = 0.3, word_limit: float = 0.42, min_chars: int = 200, min_words: int = 50
) -> DataFrame:
    """The columns ``keep`` (doc_id by default), the base counts, both distances and ``kept`` for each row."""
    refs, keep = refs or references(docs), keep or ["doc_id"]
    named = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    (also,) = unused(docs.columns, "lang")
    return map_text(docs.withColumn(also, named), text, keep, FIELDS, judge(refs, class_limit, word_limit, min_chars, min_words), also=[also])


def accepted(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with all their columns, without the rows that quality_rules rejects: rows with a null or empty text go, of
    equal rows all stay or all go."""
    own = [f"__{i}" for i in range(len(docs.columns))]
    judged = docs.select([F.col(quoted(c)).cast("string" if c == "text" else docs.schema[c].dataType).alias(x) for c, x in zip(docs.columns, own)])
    kept = quality_rules(judged, keep=own, refs=references(docs), text=own[docs.columns.index("text")], lang=own[docs.columns.index("lang")] if "lang" in docs.columns else None, **limits).where("kept")
    return kept.select([F.col(x).alias(c) for x, c in zip(own, docs.columns)])
