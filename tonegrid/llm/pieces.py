"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text becomes marked words: a space is the mark, one mark goes before the text, and a word is a run of marks with
what follows up to the next mark (or a line's end). No piece has a mark after another character, so words are encoded
apart. The distinct words of a slice of texts are sorted, which lays them out as a trie in depth-first order: going from a word
to the next keeps the forward states of their common prefix and computes those of the other characters.

Forward state of a prefix: its best last piece. For a unigram model that is the path with the highest sum of piece
scores. For a BPE model paths have no sum to maximise; a path counts only if each two neighbouring pieces are what
merging their text by itself gives, and of every prefix exactly one path does, the one that merging gives. So the
same pass yields the ids of the library for both kinds of model. Vocabularies are given, never trained.

Nulls: a null text counts as empty and has no ids. Texts are encoded whole, whatever their length. A character that
has no piece becomes its UTF-8 bytes' pieces, or the unknown piece where the model has none. Decoding gives the text
back, but for the mark character itself (U+2581), which decodes to a space, and unknown pieces. Rows are encoded one
by one, so repeated rows get equal results. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import held, map_text

MARK = "▁"
#: White space that parts words too, where the vocabulary has it in no piece with other characters: nothing merges across it.
PARTING = "\n\r\t"
#: Words and pairs of pieces that a Python worker remembers, and the length up to which a word is remembered.
CACHED_WORDS, CACHED_PAIRS, CACHED_LENGTH = 400_000, 300_000, 64
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that text can match with their ids and scores, ids of the 256 byte pieces (or none), the unknown id, and
    pieces of a BPE model that its users defined: they are taken out of a text before anything merges."""

    kind: int
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    unknown: int
    texts: list[bytes] = field(repr=False)
    name: str = ""
    defined: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model file, on the driver; what tasks get is this table."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            raw = f.read()
        model.ParseFromString(raw)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        kinds = type(model.pieces[0])
        highest = max([0.0, *(p.score for p in model.pieces if p.type == kinds.NORMAL)])  # as the library has it
        ids, scores, byte_ids, unknown, texts, defined = {}, {}, [], 0, [], []
        for i, p in enumerate(model.pieces):
            texts.append(p.piece.replace(MARK, " ").encode())
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                ids[p.piece] = i
                if p.type == kinds.NORMAL:
                    scores[p.piece] = p.score
                elif model.trainer_spec.model_type == BPE:
                    defined.append(p.piece)
                else:  # of pieces that users defined few, long ones win
                    scores[p.piece] = highest * len(p.piece) - 0.1
            elif p.type == kinds.BYTE:
                byte_ids.append(i)
                texts[i] = bytes([int(p.piece[3:5], 16)])
            else:
                texts[i] = " ⁇ ".encode() if p.type == kinds.UNKNOWN else b""
                unknown = i if p.type == kinds.UNKNOWN else unknown
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece has a mark inside, so words can't be encoded apart")
        return cls(model.trainer_spec.model_type, ids, scores, tuple(byte_ids), unknown, texts, hashlib.sha256(raw).hexdigest(), tuple(defined))


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        # pieces by their characters from the last to the first: what may end a prefix is found in one walk back
        self.back: dict = {}
        for piece in vocabulary.scores if vocabulary.kind == UNIGRAM else ():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        # and for BPE all of them by an automaton, the longest first
        self.longest, self.automaton = max(map(len, vocabulary.scores), default=1), ahocorasick.Automaton()
        for piece in vocabulary.scores if vocabulary.kind == BPE else ():
            self.automaton.add_word(piece, piece)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.penalty = min(vocabulary.scores.values(), default=0.0) - 10
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple, bool] = {}
        self.chars: dict[str, str] = {}  # one string for each character that is no piece
        parting = "".join(c for c in PARTING if not any(c in p for p in vocabulary.scores if len(p) > 1))
        self.parted = re.compile(f"{MARK}*[^{MARK}{parting}]+|{MARK}+" + (f"|[{parting}]" if parting else "")).findall
        longest = sorted(vocabulary.defined, key=len, reverse=True)
        self.taken_out = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts, score, none = list(text), self.v.scores.get, float("-inf")
        merges = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while merges and (best := max(merges)) > none:
            i = merges.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del merges[i]
            if i:
                merges[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(merges):
                merges[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def stands(self, before: str | None, piece: str) -> bool:
        """Whether merging leaves ``piece``, and the piece before it, as they are. Neighbours that make a piece
        together would merge at the latest when nothing else does."""
        if before is None:
            return self.merged(piece) == [piece]
        return before + piece not in self.v.scores and self.merged(before + piece) == [before, piece]

    def endings(self, word: str, j: int) -> list[str]:
        """The pieces that word[:j] ends with, short ones first."""
        node, found = self.back, []
        for i in range(j - 1, -1, -1):
            if (node := node.get(word[i])) is None:
                break
            if "" in node:
                found.append(node[""])
        return found

    def last_piece(self, word: str, j: int, scores: array) -> tuple[str, float]:
        """The forward state of word[:j] for a unigram model: the last piece of its best path, and the path's score."""
        best = (self.chars.setdefault(word[j - 1], word[j - 1]), scores[j - 1] + self.penalty)
        for piece in self.endings(word, j):
            if (score := scores[j - len(piece)] + self.v.scores[piece]) > best[1]:
                best = (piece, score)
        return best

    def go_on_merged(self, word: str, last: list[str | None]) -> None:
        """Appends a BPE model's forward states of the word's characters from where ``last`` ends. One automaton finds the
        pieces that end at a character, the longest first; the first that stands after its path's last piece is it."""
        pairs, done = self.pairs, len(last) - 1
        for end, piece in self.automaton.iter(word, max(0, done - self.longest + 1)) if self.v.scores else ():
            if end < done:
                continue
            while done < end:  # no piece ends there
                last.append(self.chars.setdefault(word[done], word[done]))
                done += 1
            key = (last[end + 1 - len(piece)], piece)
            stands = pairs.get(key)
            if stands is None:
                if len(pairs) >= CACHED_PAIRS:
                    pairs.clear()
                stands = pairs[key] = self.stands(*key)
            if stands:
                last.append(piece)
                done += 1
        for c in word[done:]:
            last.append(self.chars.setdefault(c, c))

    def sorted_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Sorted distinct words with their pieces. ``last[j]`` and ``scores[j]`` are the forward state of the first j
        characters: 16 bytes a character, also of a word without end, as pieces are the vocabulary's own strings."""
        last, scores, merges = [None], array("d", [0.0]), self.v.kind == BPE
        before = ""
        for word in words:
            n = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                n += 1
            del last[n + 1 :]
            if merges:
                self.go_on_merged(word, last)
            else:
                del scores[n + 1 :]
                for j in range(n + 1, len(word) + 1):
                    piece, score = self.last_piece(word, j, scores)
                    last.append(piece)
                    scores.append(score)
            pieces, j = [], len(word)
            while j:
                pieces.append(last[j])
                j -= len(last[j])
            yield word, pieces[::-1]
            before = word

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.v.ids.get(p)) is not None:
                out.append(i)
            elif self.v.byte_ids:
                out += [self.v.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.v.unknown)
        return out

    def split(self, marked: str) -> list[str]:
        """The words of a text, and the pieces that its model's users defined (the longest that fits, from left to right)."""
        if not self.taken_out:
            return self.parted(marked)
        parts = self.taken_out.split(marked)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.parted(part))]

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [self.split(MARK + t.decode().replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        words = self.words
        words |= {p: np.array([self.v.ids[p]], np.int32).tobytes() for p in self.v.defined}
        new = sorted({w for own in split for w in own if w not in words})
        for word, pieces in self.sorted_words(new):
            words[word] = array("i", self.piece_ids(pieces)).tobytes()
        out = [np.frombuffer(b"".join(map(words.__getitem__, own)), np.int32) for own in split]
        for word in new:
            if len(word) > CACHED_LENGTH:
                del words[word]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding put first."""
        raw = b"".join(map(self.v.texts.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each vocabulary in a Python worker, with what it remembers."""
    return held(("pieces", vocabulary.name), lambda: Encoder(vocabulary))


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in ids])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids or [np.empty(0, np.int32)])))


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default), and ``ids`` and ``n_pieces`` of the text."""

    def make() -> Callable:
        own = encoder(vocabulary)

        def work(texts: list) -> list:
            ids = own.encode(texts)
            return [id_lists(ids), [len(x) for x in ids]]

        return work

    return map_text(docs, "text", keep or ["doc_id"], "ids array<int>, n_pieces long", make)


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and the ``text`` of the ids. Bytes that aren't UTF-8 become U+FFFD; null ids a null text."""
    from pyspark.sql.types import StringType, StructField, StructType

    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int32)).decode(errors="replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[*keep, "text"])

    fields = encoded.select(*keep).schema.fields + [StructField("text", StringType())]
    return encoded.select(*keep, ids).mapInArrow(run, StructType(fields))


def encoding_report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """For each row: doc_id, n_pieces, n_bytes (byte pieces), a digest of the ids (xxh3-128 of them as little-endian
    int32), sha256 of the decoded text, and whether that is the text itself."""

    def make() -> Callable:
        own = encoder(vocabulary)
        is_byte = np.zeros(len(vocabulary.texts), bool)
        is_byte[list(vocabulary.byte_ids)] = True

        def work(texts: list) -> list:
            ids = own.encode(texts)
            back = [own.decode(x) for x in ids]
            return [
                [len(x) for x in ids], [int(is_byte[x].sum()) for x in ids], [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in ids],
                [hashlib.sha256(b).hexdigest() for b in back], [b == (t or b"") for b, t in zip(back, texts)],
            ]

        return work

    return map_text(docs, "text", ["doc_id"], "n_pieces long, n_bytes long, ids_xxh128 string, decoded_sha256 string, round_trip boolean", make)
