"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (blanks become U+2581, one more in front) and cut into marked words: a run of
marks and what follows up to the next mark. No piece has a mark after another character, so words
encode apart. The distinct words of a batch are sorted, which lays them out as a depth-first walk
of their trie; each character extends the forward states of its prefix by one, and a word begins
where its common prefix with the word before ends.

The forward state of a prefix is its best segmentation. For a unigram model that is the greatest
sum of piece scores (Viterbi). For a BPE model sums of scores do not give the merges' result, so a
step from one piece to the next is allowed only if merging their joined text gives back exactly
these two; each prefix then has one allowed path, the merges' own, and the forward pass finds it.

Ids are those of the library's own encoder, unknown characters as bytes where the model has them.
The model is a file whose path is a parameter; every task reads it once from the bytes sent along
(its size is that of the vocabulary).

Defined cases: a null text gives null ids and pieces count null, an empty one no ids; decoding
gives the text back except that U+2581 comes back as a blank and what the model cannot spell as its
unknown mark; null ids and repeated rows are kept, one result each. Only `doc_id` and `text` are
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame

from . import textvec as V

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words and piece pairs a task remembers; beyond that it forgets and works them out anew.
REMEMBERED = 600_000
#: Distinct words walked at a time.
WALK = 50_000
#: Characters of text encoded at a time.
CHUNK = 3_000_000
#: Ids of characters outside the vocabulary start here; WIDE is beyond all of them.
ALIEN, WIDE = 1 << 24, 1 << 25


class Model:
    """Vocabulary of one model file, with forward passes over words."""

    def __init__(self, serialized: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        spec = pb.ModelProto.FromString(serialized)
        self.decoder = SentencePieceProcessor(model_proto=serialized)
        kind = pb.ModelProto.SentencePiece.Type
        self.score, self.ids, self.bytes, self.unknown = {}, {}, {}, 0
        for i, p in enumerate(spec.pieces):
            if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED):
                self.score[p.piece], self.ids[p.piece] = p.score, i
            elif p.type == kind.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type == kind.UNKNOWN:
                self.unknown = i
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that rewrite the text before cutting it are not supported")
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses a word's end")
        self.prefixed = spec.normalizer_spec.add_dummy_prefix
        self.merging = spec.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.least = min(self.score.values(), default=0.0) - 10.0
        longer = {p[:i] for p in self.score for i in range(1, len(p))}
        #: what a string of the word may be: a piece's id (-1: none), and whether a piece goes on
        self.table = {p: (self.ids.get(p, -1), p in longer) for p in self.score.keys() | longer}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces after repeated merging of the best (then leftmost) neighbours; for short texts."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def follows(self, key: int, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces apart (and each whole); remembered by key."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        apart = self.merged(left + right) == ([left, right] if left else [right])
        self.pairs[key] = apart
        return apart

    def spelled(self, piece: str) -> tuple[int, ...]:
        """Ids of a character that is no piece."""
        if not self.bytes:
            return (self.unknown,)
        return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))

    def walk(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of sorted distinct words; states of the prefix shared with the last word are kept.

        The state of word[:j] is its score, its last piece's id (a character outside the vocabulary
        counts as ALIEN and its code) and start, and the places from which some piece may go on.
        """
        table, pairs, merging = self.table, self.pairs, self.merging
        scores, last, start, going = [0.0], [-1], [0], [()]
        before = ""
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            for held in (scores, last, start, going):
                del held[same + 1:]
            for j in range(same + 1, len(word) + 1):
                grown, best, found, at = [], None, -1, -1
                for k in (*going[j - 1], j - 1):
                    piece = word[k:j]
                    i, longer = table.get(piece, (-1, False))
                    if longer:
                        grown.append(k)
                    if i < 0:
                        if j - k > 1:
                            continue
                        i = ALIEN + ord(piece)
                    if merging:
                        if found < 0:
                            key = last[k] * WIDE + i
                            apart = pairs.get(key)
                            if apart is None:
                                apart = self.follows(key, word[start[k]:k], piece)
                            if apart:
                                found, at = i, k
                    else:
                        s = scores[k] + self.score.get(piece, self.least)
                        if best is None or s > best:
                            best, found, at = s, i, k
                scores.append(best or 0.0)
                last.append(found)
                start.append(at)
                going.append(grown)
            before, path, j = word, [], len(word)
            while j:
                i = last[j]
                if i < ALIEN:
                    path.append(i)
                else:
                    path += reversed(self.spelled(chr(i - ALIEN)))
                j = start[j]
            yield word, tuple(reversed(path))

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each text."""
        cut = [None if t is None else WORD.findall(
            (MARK if self.prefixed and t else "") + t.replace(" ", MARK)) for t in texts]
        out: list[list[int] | None] = []
        start, fresh = 0, set()
        for i, ws in enumerate(cut):
            fresh |= set(ws or ()).difference(self.known)
            if len(fresh) >= WALK or i + 1 == len(cut):
                self.known.update(self.walk(sorted(fresh)))
                known = self.known
                out += [None if c is None else [*chain.from_iterable(map(known.__getitem__, c))]
                        for c in cut[start:i + 1]]
                start, fresh = i + 1, set()
                if len(known) > REMEMBERED:
                    known.clear()
        return out


_MODELS: dict[int, Model] = {}


def _model(serialized: bytes) -> Model:
    """One model a worker process."""
    key = hash(serialized)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(serialized)
    return _MODELS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, serialized: bytes) -> DataFrame:
    """`doc_id`, `ids`, `n_pieces` and `exact` (decoding gives the text back) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(serialized)
        for frame in batches:
            texts = frame["text"].tolist()
            for a, b in V.pieces(texts, CHUNK):
                part = texts[a:b]
                ids = model.encode(part)
                same = [None if t is None else model.decoder.decode(x) == t.replace(MARK, " ")
                        for x, t in zip(ids, part)]
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[a:b], "ids": ids,
                    "n_pieces": pd.array([None if x is None else len(x) for x in ids], "Int64"),
                    "exact": pd.array(same, "boolean")})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, ids array<int>, n_pieces long, exact boolean")


def decoded(coded: DataFrame, serialized: bytes) -> DataFrame:
    """`doc_id` and `text` of every row of `coded` (`doc_id`, `ids`)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(serialized)
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [
                None if x is None else model.decoder.decode([int(i) for i in x])
                for x in frame["ids"]]})

    return coded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
