import hashlib
import pickle
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from factloom.llm import decontamination

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts, items):
    out = []
    for text in texts:
        words, hit, found = split(text), set(), set()
        for name, item in items:
            own = split(item)
            if not own:
                continue
            size = min(10, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add("" if name is None else str(name))
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def case(rng, short):
    pool = [f"w{i}" for i in range(40)] + ["Ünd", "x9", "É"]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(8, 30)))) for i in range(12)]
    items += [(100, None), (101, " ,.!"), (2, "other text of the same name " * 2), (None, " ".join(rng.choices(pool, k=14)))]
    items += [(102, "w1 w2 w3")] * short + [(103, "lonely")] * (short > 1)
    texts = []
    for _ in range(60):
        body = rng.choices(pool, k=rng.randrange(5, 80))
        _, item = rng.choice(items[:12])
        own = split(item)
        a = rng.randrange(len(own))
        body[5:5] = own[a : a + rng.randrange(1, 20)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(body).replace("w3", "W3"))
    return texts + [None, "", "...", "lonely", "w1,w2;w3", texts[0]], items


def plain_longest(texts, items):
    """The most words in a row of an item that hold a window."""
    out = []
    for text in texts:
        words, best = split(text), 0
        for own in {tuple(split(item)) for _, item in items} - {()}:
            for i in range(len(words)):
                for j in range(len(own)):
                    n = 0
                    while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                        n += 1
                    if n >= min(10, len(own)):
                        best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("short", [0, 1, 2])
@pytest.mark.parametrize("slice_bytes", [300, 1 << 20])
def test_equals_brute_force(spark, make_docs, short, slice_bytes):
    texts, items = case(random.Random(short), short)
    docs, benchmark = make_docs(texts), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, matches string")
    rows = {r["doc_id"]: r for r in decontamination.contamination(docs, benchmark, slice_bytes).collect()}
    want = plain(texts, items)
    got = [tuple(rows[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for i in range(len(texts))]
    assert got == want
    assert [rows[i]["longest_match"] for i in range(len(texts))] == plain_longest(texts, items)
    clean = decontamination.remove_contaminated(docs, benchmark, slice_bytes)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.select("doc_id").collect()) == [i for i, w in enumerate(want) if not w[4]]


def test_longest_matches(spark, make_docs):
    item = " ".join(f"a{i}" for i in range(30))
    text = " ".join(["x"] * 7 + [f"a{i}" for i in range(5, 28)] + ["y"])
    docs, benchmark = make_docs([text]), spark.createDataFrame([(4, item)], "item_id long, text string")
    (items,) = decontamination.benchmark_slices(benchmark)
    (row,) = decontamination.matches(docs, items).collect()
    assert [tuple(m) for m in row["matches"]] == [(7, 23, "4", 5)]


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontamination.contamination(make_docs(["a b"]), none).first()["contaminated"]
    assert decontamination.contamination(make_docs([]), none).count() == 0
    assert decontamination.remove_contaminated(make_docs(["a b"]), none).count() == 1


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        words = np.array([x for _ in range(rng.randrange(5)) for x in [*rng.choices([1, 2, 3], k=rng.randrange(1, 9)), 0]], np.int32)
        suffix = lambda q: words[q : q + int(np.flatnonzero(words[q:] == 0)[0]) + 1].tolist()  # noqa: E731, B023
        got = decontamination.suffix_order(words).tolist()
        assert sorted(got) == list(range(len(words)))
        assert [suffix(q) for q in got] == sorted(map(suffix, range(len(words))))


def test_windows_that_many_items_share():
    """3,000 items with one text, 300 repeats of it: hits are places, not places times items."""
    text = b" ".join(b"s%d" % i for i in range(40))
    tests = decontamination.TestSuffixes([(f"i{i}", text) for i in range(3000)] + [("other", text + b" and more of the same kind here")])
    hits = decontamination.Hits([b" x ".join([text] * 300), b"nothing"], tests)
    assert len(hits.place) == 300 * 31 and len(tests.lists) == 2
    assert len(hits.items(0)) == 3001 and hits.documents().tolist() == [0]
    assert [m[:2] for m in hits.longest(0)] == [(41 * k, 40) for k in range(300)]


def test_memory_of_a_slice():
    rng = random.Random(1)
    words = [b"w%d" % i for i in range(60_000)]
    items = [(str(i), b" ".join(rng.choices(words, k=2000))) for i in range(int(decontamination.SLICE_BYTES / 13_000))]
    code = "import sys, resource, pickle; t = pickle.load(sys.stdin.buffer); from factloom.llm import decontamination as d; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; x = pickle.dumps(d.TestSuffixes(t)); print(len(x) >> 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a >> 10)"
    out = subprocess.run([sys.executable, "-c", code], input=pickle.dumps(items), capture_output=True, check=True, cwd=Path(decontamination.__file__).parents[2])
    size, peak = map(int, out.stdout.split())
    assert size < 150 and peak < 900  # MB in a worker, and while the driver builds it


def test_very_long_text_repeated_ids_and_clashing_names(spark, make_docs):
    item = " ".join(f"a{i}" for i in range(30))
    long = " ".join(f"x{i % 977}" for i in range(200_000)) + " " + item
    docs = make_docs([long, "clean text", item, item], ids=[1, 1, None, None]).withColumnsRenamed({"size": "n_hit", "fp": "items"})
    benchmark = spark.createDataFrame([(4, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in decontamination.contamination(docs, benchmark).collect())
    assert got == [(0, 30, 30), (0, 30, 30), (1, 2, 0), (1, 200_030, 30)]
    clean = decontamination.remove_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and [r["text"] for r in clean.collect()] == ["clean text"]
