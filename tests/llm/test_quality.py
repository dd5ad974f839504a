import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import quality


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dd", "é#", " ", " ", "\n", "\n", "\t", "\xa0", "|"]), max_size=60).map("".join))
def test_base_features(text):
    assert quality.features(text)[:5] == plain(text)


def test_binomial_tail():
    p = 0.3
    pmf = [1.0]
    for _ in range(9):
        pmf = [(pmf[k] if k < len(pmf) else 0) * (1 - p) + (pmf[k - 1] if k else 0) * p for k in range(len(pmf) + 1)]
    for k in range(10):
        assert abs(quality.binomial_tail(k, 9, p) - sum(pmf[: k + 1])) < 1e-12


def test_cutoffs_need_evidence():
    counts = np.zeros((2, 2, quality.LEVELS))
    counts[0, 0, 200:210] = 50  # bad texts, high scores
    counts[:, 1, 0:20] = 100  # good texts, low scores
    cut = quality.choose_cutoff(counts, 0.05, 0.0125, 20)
    assert 20 <= cut <= 200
    counts[1, 1] = 0
    counts[1, 1, 0] = 85  # one held-out text too few: 0.95 ** 85 > 0.0125
    assert quality.choose_cutoff(counts, 0.05, 0.0125, 20) == quality.LEVELS
    counts[1, 1, 0] = 86
    assert quality.choose_cutoff(counts, 0.05, 0.0125, 20) == 200


def test_family_wise_error_is_limited():
    """Over many draws of four strata, draws with any cutoff whose true rate of false rejection is above the limit are rare."""
    rng, bad, found = np.random.default_rng(4), 0, 0
    rate = 0.08 * (quality.LEVELS - np.arange(quality.LEVELS)) / quality.LEVELS  # true share of good texts at or above each score
    weights = np.append(-np.diff(rate), rate[-1])
    weights[0] += 1 - weights.sum()
    for _ in range(500):
        cuts = []
        for n in (120, 300, 900, 2000):
            counts = np.zeros((2, 2, quality.LEVELS))
            counts[1, 1] = rng.multinomial(n, weights)
            counts[0, 0, :] = 5
            cuts.append(quality.choose_cutoff(counts, 0.05, 0.05 / 4, 0.0))
        bad += any(cut < quality.LEVELS and rate[cut] > 0.05 for cut in cuts)
        found += sum(cut < quality.LEVELS for cut in cuts)
    assert bad <= 0.05 * 500 + 10 and found > 1000


def plain_verdicts(docs, labels, risk=0.05, delta=0.05, cost=20):
    """doc_id -> kept, from (doc_id, text, lang) and (doc_id, quality)."""
    worst = {}
    for i, q in labels:
        if i is not None and q is not None:
            worst[i] = min(q > 0, worst.get(i, True))
    texts, passed = {}, {}
    for i, text, lang in docs:
        words, _, _, _, repeated = plain(text)
        passed[i] = words >= 50 and 100 * repeated <= 50 * words
        if passed[i] and i in worst:
            texts[lang, text] = min(worst[i], texts.get((lang, text), True))
    levels = {t: quality.features(t)[5:] for _, t, _ in docs}
    held = {t: (quality.content_number(t) >> 5) % 4 > 0 for t in levels}
    train = [(levels[t], good) for (_, t), good in texts.items() if not held[t]]
    share = lambda rule, level, good: (sum(x[rule] >= level and g == good for x, g in train) + 0.5) / (sum(g == good for _, g in train) + 1)
    ratios = [[0.0] + [math.log(share(r, lv, False)) - math.log(share(r, lv, True)) for lv in range(1, 256)] for r in range(4)]
    score = lambda t: max(min(255, max(0, round(16 * max(ratios[r][: levels[t][r] + 1])))) for r in range(4))
    scores, cuts = {t: score(t) for t in levels}, {}
    strata = {lang for lang, _ in texts}
    for lang in strata:
        own = [(scores[t], good, held[t]) for (at, t), good in texts.items() if at == lang]
        n, best = sum(g and h for _, g, h in own), 0
        for cut in range(255, 0, -1):
            k = sum(s >= cut and g and h for s, g, h in own)
            if not n or sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) > delta / len(strata):
                break
            gain = sum(s >= cut and not g for s, g, _ in own) - cost * sum(s >= cut and g for s, g, _ in own)
            if gain > best:
                best, cuts[lang] = gain, cut
    return {i: passed[i] and scores[t] < cuts.get(lang, 256) for i, t, lang in docs}, cuts


def test_verdicts_equal_brute_force(spark, make_docs):
    rng = random.Random(7)
    good = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(500)]
    loud = [" ".join(f"w{rng.randrange(900)}".upper() for _ in range(80)) for _ in range(12)]
    junk = [" ".join(f"w{rng.randrange(900)}" + "#" * rng.randrange(4) for _ in range(80)) for _ in range(60)]
    texts = [*good, *loud, *junk, *good[:40], *junk[:20], None, "", "short", "a b c " * 40, "x" * 300_000 + " w" * 60]
    labels = [(i, int(i < 512 or 572 <= i < 612), 0) for i in range(632) if i % 9]  # of equal texts some have no label
    frame = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(texts)
    want, cuts = plain_verdicts([(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)], [*((i, q) for i, q, _ in labels), (7, 0)])
    assert set(cuts) == {"en", "de", None} and sum(not x for x in want.values()) > 30
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(docs, frame).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = plain(text)
        assert tuple(rows[i][c] for c in quality.COUNTS) == base
        assert rows[i]["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    assert {i: r["kept"] for i, r in rows.items()} == want
    clash = docs.withColumnsRenamed({"size": "n_words", "fp": "_content"}).withColumn("Content", docs["doc_id"])
    kept = quality.keep_good(clash, frame)
    assert kept.columns == clash.columns
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in sorted(want) if want[i]]
    assert all(r["n_words"] == r["doc_id"] == r["Content"] and r["_content"] == "x" for r in got)


def test_repeated_rows_are_judged_each(spark, make_docs):
    texts = [" ".join(map(str, range(60)))] * 3 + ["short"] * 2
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(texts, ids=[1, 1, None, 2, 2])
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in quality.quality_verdicts(docs, none).collect()) == [(0, True), (1, True), (1, True), (2, False), (2, False)]
    assert quality.keep_good(docs, none).count() == 3


def test_without_labels_only_base_rules_hold(spark, make_docs):
    docs, none = make_docs(["### " * 60, " ".join(map(str, range(60))), None]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs, none).collect()} == {0: False, 1: True, 2: False}
    assert quality.quality_verdicts(make_docs([]), none).count() == 0
