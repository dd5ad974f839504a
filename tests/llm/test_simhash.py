import random
import time

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(docs, texts, **options):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs, **options).collect()}
    prints = [plain_print(t) for t in texts]
    assert [int(rows[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert [rows[i]["component_id"] for i in range(len(texts))] == plain_components(prints)


def test_random_near_copies(spark, make_docs):
    rng = random.Random(1)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(120)] = f"x{rng.randrange(99)}"
            texts.append(" ".join(own))
    texts += [None, "", " ", " \t", "one two", "ONE Two", "a b c d", "a b c d e", "Ärger ärger", texts[0], texts[0]]
    check(make_docs(texts), texts)
    check(make_docs(texts), texts, block=3)


def test_links_of_crafted_fingerprints(spark):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centre for _ in range(12)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (4, 1000):
        links = [(r["u"], r["v"]) for r in simhash.near_links(nodes, block).collect()]
        at = {x: i for i, x in enumerate(signed)}
        assert all((prints[at[u]] ^ prints[at[v]]).bit_count() <= 4 for u, v in links)
        rows = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
        groups: dict = {}
        for i, x in enumerate(signed):
            groups.setdefault(rows.get(x, x), set()).add(i)
        want: dict = {}
        for i, root in enumerate(plain_components(prints)):
            want.setdefault(root, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (7, 7)], "u long, v long")
    rows = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert rows == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def test_keep_one(spark, make_docs):
    texts = ["the same words here now", "the same words here now", "quite another text of words", None, None]
    kept = simhash.keep_one(make_docs(texts))
    assert kept.columns == make_docs(texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert simhash.keep_one(make_docs([])).count() == 0


def test_keep_one_loses_no_component(spark, make_docs):
    texts, ids = ["aa bb cc dd ee"] * 2 + ["quite another text of words"] + ["one more text all alone"] + ["null"] + ["of no id at all"] * 3 + ["also of no id here"], [1, 1, 1, 2, 3] + [None] * 4
    docs = make_docs(texts, ids=ids).withColumnsRenamed({"size": "_key", "fp": "id"}).withColumn("FP", F.lit("mine"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["text"] for r in rows) == sorted(set(texts))
    assert all(ids[r["_key"]] == r["doc_id"] and texts[r["_key"]] == r["text"] and r["id"] == "x" and r["FP"] == "mine" for r in rows)


def test_null_ids_and_the_id_null(spark):
    rows = [(None, "some words that are first"), ("null", "other words that are second"), (None, "third words of another kind"), ("b", "some words that are first")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted((r["doc_id"] or "", r["text"]) for r in kept.collect()) == sorted([("null", rows[1][1]), ("", rows[2][1]), ("b", rows[3][1])])


def test_very_long_text(spark, make_docs):
    texts = [" ".join(f"w{i % 991}" for i in range(300_000)), "x" * 500_000, "short one"]
    check(make_docs(texts), texts)


def rooted(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_buckets_over_many_batches():
    """Buckets of one row, of a few and of more than LAGS; cut into batches anywhere; links join what the 64 keys join, and no more."""
    rng = random.Random(6)
    prints = sorted({rng.choice([0, 5 << 43, 9 << 22]) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(700)} | {rng.getrandbits(64) for _ in range(50)})
    rows = sorted((k << simhash.HALF | p >> at & (1 << n) - 1, 0, 0, p) for p in prints for k, ((at, n), _) in enumerate(simhash.HALVES))
    want = plain_components(prints)
    at = {p: i for i, p in enumerate(prints)}
    for size in (1, 7, 500, 10_000):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        columns = [[pa.array(c, pa.int32()) for c in list(zip(*part, strict=True))[:3]] + [pa.array(np.array([r[3] for r in part], np.uint64).view(np.int64))] for part in cut]
        batches = (pa.RecordBatch.from_arrays(c, ["bucket", "i", "j", "fp"]) for c in columns)
        out = [(u % 2**64, v % 2**64) for b in simhash._links_of_buckets(batches) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert all((u ^ v).bit_count() <= 4 for u, v in out)
        assert rooted(len(prints), [(at[u], at[v]) for u, v in out]) == want


def test_work_follows_the_number_of_fingerprints(spark):
    """Where most keys hold three unrelated fingerprints or more, all near pairs are found without a step for each key."""
    n = 600_000
    near = spark.range(0, n, 100).selectExpr("xxhash64(id) ^ shiftleft(7L, int(id % 61)) ^ shiftleft(1L, int(id % 31)) AS fp")
    nodes = spark.range(n).selectExpr("xxhash64(id) AS fp").unionByName(near).distinct().localCheckpoint()
    began = time.perf_counter()
    rows = {r["node"]: r["component"] for r in simhash.components(simhash.near_links(nodes)).collect()}
    took = time.perf_counter() - began
    pairs = spark.range(0, n, 100).selectExpr("xxhash64(id) AS u", "xxhash64(id) ^ shiftleft(7L, int(id % 61)) ^ shiftleft(1L, int(id % 31)) AS v").collect()
    assert all(rows[r["u"]] == rows[r["v"]] for r in pairs)
    assert took < 40, f"{took:.0f} seconds"
