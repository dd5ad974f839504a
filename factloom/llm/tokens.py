"""Token counts by dynamic programming shared along a trie.

A unigram tokenizer cuts each pre-token into the pieces with the best sum of scores.  The distinct
pre-tokens of a piece of work are inserted in a trie; the best score and the number of pieces up
to a node depend on the node's prefix alone, so they are computed once per node, and each
pre-token's count is stored at its terminal.  Visiting pre-tokens in sorted order walks the trie
depth first with only the current path in memory.

The vocabulary is a sentencepiece model file whose path is a parameter.  Unigram models bring their own scores.  The scores
of a BPE model only number its merges; then ``corpus_scores`` counts the model's own pieces in all documents, and a piece's score
is the log of its share (one added to each count): the unigram language model of the published tokenizer's output.  Neither
vocabulary nor merges are changed.  Pre-tokens are runs without white space, each with the model's word mark in front.  A character
without a piece has the least score less ten, as in the library; it counts as its UTF-8 bytes if the vocabulary has byte pieces,
else a run of such characters counts as one.  Of equal scores the
one with the longer last piece counts, also as in the library.

Null and blank texts have no tokens.  Pre-tokens longer than ``WHOLE`` characters are counted by the
same recurrence on their own, outside the trie, in memory bounded by the longest piece.
Repeated rows and ids count alike; empty tables give no rows; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import pieces

MARK, WHOLE, KNOWN = "▁", 256, 300_000
SPACED = re.compile("[^\x20\x09-\x0d]+")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: whole numbers as such, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, message[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """names, scores and types of the pieces by number; unigram: whether the scores are log probabilities."""

    names: list[str]
    scores: list[float]
    types: list[int]
    unigram: bool

    def with_scores(self, scores: list[float]) -> Vocabulary:
        return Vocabulary(self.names, scores, self.types, True)


def read_vocabulary(model: bytes) -> Vocabulary:
    """A sentencepiece model file's contents."""
    names, scores, types, kind = [], [], [], 1
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            names.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = dict(fields(value)).get(3, 1)
    return Vocabulary(names, scores, types, kind == 1)


class Unigram:
    def __init__(self, vocabulary: Vocabulary):
        every = list(zip(vocabulary.names, vocabulary.scores, vocabulary.types))
        normal = [x for _, x, t in every if t == NORMAL]
        most = max(normal, default=0.0)
        scores = {p: x for p, x, t in every if t == NORMAL and p}
        # As in the library: the score of a piece of the user's grows with its length, so that it is preferred.
        scores |= {p: len(p.encode()) * most - 0.1 for p, _, t in every if t == USER_DEFINED and p}
        self.longest, self.unknown, self.bytes = max(map(len, scores), default=1), min(normal, default=0.0) - 10.0, BYTE in vocabulary.types
        #: Every suffix of every piece: its score, or None if it is no piece itself.
        self.suffixes: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))}
        self.suffixes.update(scores)

    def step(self, word: str, i: int, path: list[tuple[float, int, bool]]) -> tuple[float, int, bool]:
        """The state of the prefix word[:i], given those of all shorter prefixes: (score, pieces, whether it ends in an unknown character)."""
        get, best = self.suffixes.get, (-math.inf, 0, False)
        for j in range(i - 1, -1, -1):
            s = get(word[j:i], False)
            if s is not None and s is not False:
                before = path[j - i]
                if before[0] + s >= best[0]:
                    best = (before[0] + s, before[1] + 1, False)
            elif j == i - 1:
                before = path[-1]
                best = (before[0] + self.unknown, before[1] + (len(word[j].encode()) if self.bytes else not before[2]), True)
            if s is False:
                break  # no piece ends with this, so none with more
        return best

    def count(self, word: str) -> int:
        """Pieces of one word; the states kept are as many as the longest piece has characters."""
        path = [(0.0, 0, False)]
        for i in range(1, len(word) + 1):
            path.append(self.step(word, i, path))
            if len(path) > 4 * self.longest:
                del path[: -self.longest - 1]
        return path[-1][1]

    def counts(self, words: list[str]) -> dict[str, int]:
        """Pieces of each distinct word, one step per node of their trie."""
        out, path, last = {}, [(0.0, 0, False)], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                path.append(self.step(word, i, path))
            out[word], last = path[-1][1], word
        return out


def corpus_scores(docs: DataFrame, model: bytes) -> Vocabulary:
    """The model's vocabulary with log shares of its pieces in all documents, as the model itself cuts them.

    Tasks encode different words with their counts and sum by piece; the driver gets one number a piece.
    """
    vocabulary, shared = read_vocabulary(model), docs.sparkSession.sparkContext.broadcast(model)
    size = len(vocabulary.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoder, words, total = sentencepiece.SentencePieceProcessor(model_proto=shared.value), Counter(), np.zeros(size)

        def flush() -> None:
            found = encoder.encode(list(words), num_threads=1)
            ids = np.fromiter((i for own in found for i in own), np.int64)
            total[:] += np.bincount(ids, np.repeat(np.fromiter(words.values(), np.float64), [len(own) for own in found]), size)
            words.clear()

        for b in pieces(batches, 2048):
            for text in b.column(0).to_pylist():
                if text:
                    words.update(SPACED.findall(text))
            if len(words) > KNOWN:
                flush()
        if words:
            flush()
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids].astype(np.int64))], ["piece", "n"])

    counts = np.ones(size)
    for r in docs.select("text").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[r["piece"]] += r["n"]
    own = np.isin(vocabulary.types, (NORMAL, USER_DEFINED))
    return vocabulary.with_scores(np.log(counts / counts[own].sum()).tolist())


def load_vocabulary(docs: DataFrame, model_path: str) -> Vocabulary:
    """With scores that are log probabilities: the model's own, or else the corpus'."""
    model = Path(model_path).read_bytes()
    vocabulary = read_vocabulary(model)
    return vocabulary if vocabulary.unigram else corpus_scores(docs, model)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_chars for every whole text.

    The vocabulary is read by the driver and broadcast.  A task keeps the counts of at most
    ``KNOWN`` words; forgetting them costs time, not correctness.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(docs, model_path))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Unigram(shared.value), {}
        for b in pieces(batches, 2048):
            texts = b.column(1).to_pylist()
            if len(known) > KNOWN:
                known.clear()
            new: set[str] = set()
            for text in texts:
                if text:
                    new.update(SPACED.findall(text))
            new.difference_update(known)
            found = model.counts([MARK + w for w in new if len(w) <= WHOLE])
            known.update((w[1:], n) for w, n in found.items())
            rows = []
            for text in texts:
                words = SPACED.findall(text) if text else []
                try:
                    n = sum(map(known.__getitem__, words))
                except KeyError:
                    n = sum(known[w] if len(w) <= WHOLE else model.count(MARK + w) for w in words)
                rows.append((len(words), n, len(text or "")))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_tokens", "n_chars"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, n_words long, n_tokens long, n_chars long")
