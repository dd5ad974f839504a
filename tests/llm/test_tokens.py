import math
import random
import struct
from collections import Counter
from pathlib import Path

import pytest
import sentencepiece

from factloom.llm import tokens
from factloom.llm.queries import MODEL_PATH


def brute(word, model):
    """The best of all segmentations, by plain recursion over cuts."""
    scores = {p: s for p, s in model.suffixes.items() if s is not None}
    best = {0: (0.0, 0, False)}
    for i in range(1, len(word) + 1):
        ways = [(best[j][0] + scores[word[j:i]], best[j][1] + 1, False) for j in range(i) if word[j:i] in scores]
        if word[i - 1] not in scores:
            ways.append((best[i - 1][0] + model.unknown, best[i - 1][1] + (len(word[i - 1].encode()) if model.bytes else not best[i - 1][2]), True))
        best[i] = max(ways, key=lambda w: w[0])  # the first of equal ones: the longest last piece
    return best[len(word)][1]


def vocabulary(scores, user=(), with_bytes=False):
    names = ["<unk>", *scores, *user, *(f"<0x{i:02X}>" for i in range(256 * with_bytes))]
    types = [tokens.UNKNOWN] + [tokens.NORMAL] * len(scores) + [tokens.USER_DEFINED] * len(user) + [tokens.BYTE] * 256 * with_bytes
    return tokens.Vocabulary(names, [0.0, *scores.values(), *[0.0] * (len(names) - 1 - len(scores))], types, True)


def model_file(own, with_bytes):
    """A unigram model file with given pieces, written by hand."""
    field = lambda number, raw: bytes([number << 3 | 2]) + (bytes([len(raw)]) if len(raw) < 128 else bytes([len(raw) & 127 | 128, len(raw) >> 7])) + raw
    out = b"".join(field(1, field(1, n.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, t])) for n, s, t in zip(own.names, own.scores, own.types))
    trainer = bytes([0x18, 1]) + (bytes([0x98, 0x02, 1]) if with_bytes else b"")  # unigram; byte fallback
    return out + field(2, trainer) + field(3, field(1, b"identity") + bytes([0x18, 1, 0x20, 1, 0x28, 1]))


def random_scores(rng):
    scores = {tokens.MARK: -4.0} | {c: -5.0 - rng.random() for c in "ab"} | {"".join(rng.choices("abc", k=rng.randrange(2, 5))): -rng.random() * 8 for _ in range(25)}
    return scores | {tokens.MARK + "ab": -3.3, "é": 0.0}  # a score may be 0


@pytest.mark.parametrize("with_bytes", [False, True])
def test_trie_equals_brute_force_and_the_library(with_bytes):
    rng = random.Random(3)
    own = vocabulary(random_scores(rng), ["éab"], with_bytes)
    model = tokens.Unigram(own)
    words = sorted({tokens.MARK + "".join(rng.choices("abcéü", k=rng.randrange(1, 12))) for _ in range(400)})
    want = {w: brute(w, model) for w in words}
    assert model.counts(words) == want
    assert {w: model.count(w) for w in words} == want
    assert model.count("é") == 1
    raw = model_file(own, with_bytes)
    assert tokens.read_vocabulary(raw).names == own.names and tokens.read_vocabulary(raw).unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert {w: len(library.encode(w[1:])) for w in words} == want


def test_published_vocabulary(spark, make_docs, sample):
    long = "ab" * 5000
    texts = [r["text"] for r in sample.limit(20).collect()] + [None, "", " \n", "日本語 text", long, f"{long} end"]
    docs = make_docs(texts).withColumnsRenamed({"size": "n_words", "fp": "n"})
    raw = Path(MODEL_PATH).read_bytes()
    assert not tokens.read_vocabulary(raw).unigram
    fitted = tokens.load_vocabulary(docs, MODEL_PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    assert fitted.names == [library.id_to_piece(i) for i in range(library.vocab_size())]
    counts = Counter(i for t in texts for w in tokens.SPACED.findall(t or "") for i in library.encode(w))
    own = [i for i, t in enumerate(fitted.types) if t in (tokens.NORMAL, tokens.USER_DEFINED)]
    total = sum(counts[i] + 1 for i in own)
    assert all(fitted.scores[i] == pytest.approx(math.log((counts[i] + 1) / total)) for i in own)
    model = tokens.Unigram(fitted)
    rows = {r["doc_id"]: r for r in tokens.count_tokens(docs, MODEL_PATH).collect()}
    for i, text in enumerate(texts):
        words = tokens.SPACED.findall(text or "")
        want = sum(brute(tokens.MARK + w, model) if len(w) < 300 else model.count(tokens.MARK + w) for w in words)
        assert (rows[i]["n_words"], rows[i]["n_tokens"]) == (len(words), want)
    assert tokens.count_tokens(make_docs([]), MODEL_PATH).count() == 0


def test_repeated_rows_and_ids(spark, make_docs):
    rows = tokens.count_tokens(make_docs(["one two", "one two", "three"], ids=[1, 1, None]), MODEL_PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == [(0, 1), (1, 2), (1, 2)]
