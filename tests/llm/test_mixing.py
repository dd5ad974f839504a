import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by repeated sharing: what is above a limit is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, total = set(names), {}, share * sum(sizes.values())
    while left:
        rest = total - sum(out.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > most * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= set(over)
    return out


def systematic(rows, targets, sizes, seed="mix"):
    """rows: (doc_id, source, size) -> copies, by walking through each source's prefix sums."""
    out = {}
    for source in targets:
        own = sorted((n, hashlib.md5(str(i).encode()).hexdigest(), i) for i, s, n in rows if s == source)
        u = int(hashlib.md5((seed + ("" if source is None else f"={source}")).encode()).hexdigest()[:4], 16) / 65536
        r = targets[source] / sizes[source] if sizes[source] else 0.0
        for k, (_, _, i) in enumerate(own, 1):
            out[i] = math.floor(k * r + u) - math.floor((k - 1) * r + u)
    return out


def table(texts, make_docs):
    docs = make_docs(texts)
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    return docs, rows, sizes


def test_mix_equals_brute_force(spark, make_docs):
    texts = [" ".join(["w"] * (1 + i * 7 % 50)) for i in range(200)] + [None, "", " \t\n", "a\xa0b", "é \x1f ü"] + ["same size"] * 80
    docs, rows, sizes = table(texts, make_docs)
    targets = fill(sizes)
    want = systematic(rows, targets, sizes)
    got = {r["doc_id"]: r for r in mixing.plan_mix(docs).collect()}
    assert len(got) == len(texts)
    for i, source, n in rows:
        assert (got[i]["size"], got[i]["source_size"], got[i]["copies"]) == (n, sizes[source], want[i])
        assert got[i]["target"] == pytest.approx(targets[source]) and got[i]["taken"] == want[i] * n <= 2 * n
    for source, target in targets.items():
        assert abs(sum(got[i]["taken"] for i, s, _ in rows if s == source) - target) <= 2 * max(n for _, s, n in rows if s == source)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in want.items() if c}


def test_code_point_order_and_limits(spark):
    sizes = {"Z": 10, "a": 1000, "é": 5, "\U0001f600": 7, "￮": 900, None: 40}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = fill(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_repeated_ids_and_empty(spark, make_docs):
    docs = make_docs(["a b c", "d", "e f", None], ids=[1, 1, None, None])
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == 4
    assert mixing.mix_documents(docs).count() == sum(r["copies"] for r in plan)
    assert mixing.plan_mix(make_docs([])).count() == mixing.mix_documents(make_docs([])).count() == 0
    assert mixing.plan_mix(make_docs([None, ""])).agg({"taken": "sum"}).first()[0] == 0


def test_repeated_ids_clashing_names_and_long_texts(spark, make_docs):
    texts = ["w " * 300_000, *(f"{'x ' * (i % 9)}" for i in range(120))]
    ids = [i // 2 if i < 60 else None for i in range(121)]
    docs = make_docs(texts, ids=ids).withColumnsRenamed({"size": "_key", "fp": "copies"}).withColumn("Row", F.lit(7))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert all(texts[r["_key"]] == r["text"] and ids[r["_key"]] == r["doc_id"] and (r["copies"], r["Row"]) == ("x", 7) for r in got)
    times = Counter(r["_key"] for r in got)
    assert max(times.values()) <= 2
    rows = [(r["_key"], r["source"], len((r["text"] or "").split())) for r in docs.collect()]
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    most = max(n for k, _, n in rows if k)
    for source, target in fill(sizes).items():
        taken = sum(times[k] * n for k, s, n in rows if s == source)
        assert abs(taken - target) <= 2 * (300_000 if source == "a" else most)


def test_the_id_null_is_not_a_null_id(spark):
    rows = [("null", "a b c", "s"), (None, "d e", "s"), ("k", "f", "s")]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    assert len({tuple(r) for r in got} - set(rows)) == 0
