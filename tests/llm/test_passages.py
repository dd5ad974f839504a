import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import passages


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=0, max_size=60), st.integers(0, 2))
def test_winnowing_leaves_no_window_out(values, wide):
    h = np.array([v % (3 if wide == 0 else 2**40) for v in values], np.uint64)
    at = set(passages.winnowed(h).tolist())
    for i in range(len(h) - passages.WINNOW + 1):
        window = range(i, i + passages.WINNOW)
        assert any(j in at and h[j] == min(h[k] for k in window) for j in window)
    assert bool(at) == bool(len(h))


def plain_best(pos, apos):
    """Best chain score by the quadratic recurrence."""
    score = []
    for i in range(len(pos)):
        reach = [score[j] - passages.GAP_COST * (pos[i] - pos[j] + apos[i] - apos[j]) for j in range(i) if apos[j] < apos[i]]
        score.append(passages.K + max([0.0, *reach]))
    return max(score)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=25), st.randoms())
def test_fenwick_chain_is_the_best(apos, rng):
    pos = sorted(rng.sample(range(50), len(apos)))  # no gap is beyond MAX_GAP
    chains = passages.best_chains(pos, apos)
    assert sorted(i for c in chains for i in c) == list(range(len(pos)))
    for c in chains:
        assert all(pos[x] < pos[y] and apos[x] < apos[y] for x, y in zip(c, c[1:]))
    first = chains[0]
    steps = sum(passages.GAP_COST * (pos[y] - pos[x] + apos[y] - apos[x]) for x, y in zip(first, first[1:]))
    assert abs(passages.K * len(first) - steps - plain_best(pos, apos)) < 1e-6


def test_edit_distance():
    assert passages.edit_distance(list("kitten"), list("sitting")) == 3
    assert passages.edit_distance([], [1, 2]) == 2


def words(rng, n, tag):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def spans(row, column):
    return [tuple(map(int, s.split(":"))) for s in row[column].split(",") if s]


def test_planted_passages(spark, make_docs):
    rng = random.Random(5)
    exact, fuzzy, short = words(rng, 60, "p"), words(rng, 80, "q"), words(rng, 30, "s")
    texts, where = [], {}
    for i in range(30):
        body = words(rng, 100, "w")
        if i % 3 == 0:
            body[40:40] = exact
            where[i] = (40, 100)
        elif i % 3 == 1:
            own = list(fuzzy)
            for k in range(7, 80, 16):
                own[k] = f"z{rng.randrange(10**6)}"
            if i % 2:
                del own[30]
            body[10:10] = own
            where[i] = (10, 10 + len(own))
        else:
            body[5:5] = short
        texts.append(" \n"[i % 2].join(body))
    texts += [None, "", "a b", " ".join(words(rng, 5, "v") * 100), texts[3]]
    rows = {r["doc_id"]: r for r in passages.repeated_passages(make_docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, (s, e) in where.items():
        column = "first_spans" if i in (0, 1) else "repeated_spans"
        if i != 3:  # document 34 is a copy of 3
            ((a, z),) = spans(rows[i], column)
            assert abs(a - s) <= 3 and abs(z - e) <= 3, (i, a, z, s, e)
        if i not in (0, 1):
            assert rows[i]["class_id"] == i % 3 and rows[i]["n_links"] >= 1
    for i in [*range(2, 30, 3), 30, 31, 32, 33]:
        assert (rows[i]["n_repeated"], rows[i]["n_first"], rows[i]["n_links"], rows[i]["class_id"]) == (0, 0, 0, i)
    assert spans(rows[34], "repeated_spans") == [(0, 160)]
    left = passages.without_words(texts[6], rows[6]["repeated_spans"])
    assert len(left.split()) == 100
    assert passages.repeated_passages(make_docs([])).count() == 0


def test_repeated_rows_and_ids(spark, make_docs):
    rng = random.Random(6)
    text = " ".join(words(rng, 80, "a"))
    rows = passages.repeated_passages(make_docs([text, text, "other words", text], ids=[1, 1, 1, None])).collect()
    assert len(rows) == 4 and all(r["n_links"] == 0 for r in rows)


def pair_spans(left, right):
    """What the functions find in ``right`` of ``left``, joined, without Spark."""
    def seeds(x):
        h = passages.kmers(np.array(x, np.uint64))
        at = passages.winnowed(h)
        return dict(zip(passages.occurrence_seeds(h[at])[0].tolist(), at.tolist()))

    a, b = seeds(left), seeds(right)
    found = sorted((b[h], a[h]) for h in b if h in a)
    pos, apos = [p for p, _ in found], [q for _, q in found]
    out = []
    for c in passages.best_chains(pos, apos) if found else []:
        if len(c) > 1 and pos[c[-1]] - pos[c[0]] + passages.K >= passages.MIN_CHAIN:
            out += [(s, e) for s, e, _, _ in passages.aligned(right, left, [pos[i] for i in c], [apos[i] for i in c])]
    return [s for s in out if s[1] - s[0] >= passages.MIN_WORDS]


@pytest.mark.parametrize("n", [60, 80, 150])
@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15])
def test_recall_of_fuzzy_passages(n, rate):
    """Passages with random words changed, of those that keep 0.8 of their words."""
    rng, found, trials = random.Random(n), 0, 0
    new = lambda k: [rng.getrandbits(60) for _ in range(k)]
    while trials < 200:
        passage = new(n)
        copy = [w if rng.random() > rate else rng.getrandbits(60) for w in passage]
        if sum(x == y for x, y in zip(passage, copy)) >= passages.IDENTITY * n:
            trials += 1
            found += bool(pair_spans(new(100) + passage + new(100), new(80) + copy + new(120)))
    assert found >= 0.9 * trials, found


def test_occurrences():
    own = np.array([5, 7, 5, 5, 9, 7], np.uint64)
    mixed, again = passages.occurrence_seeds(own)
    assert len(set(mixed.tolist())) == 6 and again.tolist() == [2, 3, 5] and mixed[[0, 1, 4]].tolist() == [5, 7, 9]
    assert mixed[2] == passages.occurrence_seeds(own[:3])[0][2] and len(passages.occurrence_seeds(own[:0])[0]) == 0


def test_unrelated_texts_have_no_passages():
    rng = random.Random(1)
    common = [rng.getrandbits(60) for _ in range(300)]
    texts = [[rng.choice(common) for _ in range(400)] for _ in range(60)]
    assert not any(pair_spans(a, b) for i, a in enumerate(texts) for b in texts[:i])


def test_passage_of_sentences_that_stand_elsewhere_first(spark, make_docs):
    rng, texts = random.Random(2), []
    for _ in range(12):
        sentences = [words(rng, 12, "s") for _ in range(5)]
        for s in sentences:
            texts.append(words(rng, 60, "w") + s + words(rng, 60, "w"))
        for _ in range(2):
            texts.append(words(rng, 50, "w") + sum(sentences, []) + words(rng, 50, "w"))
    rows = {r["doc_id"]: r for r in passages.repeated_passages(make_docs([" ".join(t) for t in texts])).collect()}
    later = range(6, 84, 7)
    found = [i for i in later if rows[i]["earlier_ids"] == [i - 1] and rows[i]["n_repeated"] >= 58]
    assert len(found) >= 0.9 * len(later), [(i, rows[i]) for i in later if i not in found]
    assert all(rows[i]["n_repeated"] == 0 for i in range(84) if i not in later)


def test_string_ids_ties_and_clashing_names(spark, make_docs):
    rng = random.Random(4)
    passage = words(rng, 70, "p")
    texts = [" ".join(words(rng, 40, "w") + passage + words(rng, 40, "w")) for _ in range(3)] + [" ".join(words(rng, 90, "w")), None, "", "few words"]
    docs = make_docs(texts).withColumnsRenamed({"size": "h", "fp": "number"})
    number = passages.repeated_passages(docs).collect()
    named = passages.repeated_passages(docs.withColumn("doc_id", F.concat(F.lit("doc"), "doc_id"))).collect()
    as_name = lambda r: (f"doc{r['doc_id']}", r["n_repeated"], r["repeated_spans"], [f"doc{i}" for i in r["earlier_ids"]], r["n_first"], r["first_spans"], r["n_links"], f"doc{r['class_id']}")
    assert sorted(map(as_name, number)) == sorted(map(tuple, named))
    assert [r["earlier_ids"] for r in sorted(named, key=lambda r: r["doc_id"])[:3]] == [[], ["doc0"], ["doc0"]]


def test_very_long_text(spark, make_docs):
    rng = random.Random(6)
    passage = words(rng, 70, "p")
    texts = [" ".join(words(rng, 100_000, "w") + passage), " ".join(passage), "same " * 50_000, "same " * 50_000]
    rows = {r["doc_id"]: r for r in passages.repeated_passages(make_docs(texts)).collect()}
    assert spans(rows[1], "repeated_spans") == [(0, 70)] and rows[3]["n_repeated"] >= 49_000
