import hashlib
import math
import random
import re
import time
import uuid
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import ids, text, vectors

TEXTS = ["", "a", "the cat sat", "the cat sat on a mat", "abc", "bcd", "kitten", "sitting", "Éa é É", "aé_1 b-2", "A  b\tc ", "xx yy xx", " lead", "load balancer", "loadbalancr"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def ratio(a, b):
    return 1.0 if a == b else 1 - lev(a, b) / max(len(a), len(b))


def window(n, h):
    if not n or not h:
        return 0.0
    off = max(2, len(n) // 3)
    low = max(1, len(n) - off)
    if low > len(h):
        return ratio(n, h)
    return max(ratio(n, h[i : i + w]) for w in {low, len(n), len(n) + off} if w <= len(h) for i in range(len(h) - w + 1))


def words(t):
    return re.findall(r"\w+", t.lower())


def multiset(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def overlap(a, b):
    x, y = set(words(a)), set(words(b))
    return len(x & y) / len(x | y) if x and y else 0.0


def chars(a, b):
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similarities_equal_plain_python(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    rows = df.select("i", text.words("a").alias("w"), text.multiset_jaccard("a", "b").alias("m"), text.lexical_overlap("a", "b").alias("o"), text.char_jaccard("a", "b").alias("c"),
                     text.edit_ratio("a", "b").alias("e"), text.best_window_ratio("a", "b").alias("bw"), text.name_match("a", "b").alias("n")).collect()
    for r in rows:
        _, a, b = pairs[r["i"]]
        assert r["w"] == words(a)
        for got, want in ((r["m"], multiset(a, b)), (r["o"], overlap(a, b)), (r["c"], chars(a, b)), (r["e"], ratio(a, b)), (r["bw"], window(a, b))):
            assert got == pytest.approx(want), (a, b)
        n = a.strip().lower()
        assert r["n"] == pytest.approx(0.0 if not n or not b else 1.0 if n in b.lower() else ratio(n, b.lower()))


def test_known_values(spark):
    row = spark.range(1).select(
        text.multiset_jaccard(F.lit("the cat sat"), F.lit("the cat sat on a mat")).alias("m"), text.char_jaccard(F.lit("abc"), F.lit("bcd")).alias("c"), text.edit_ratio(F.lit("kitten"), F.lit("sitting")).alias("e"),
        text.squeezed(F.lit("  A \n b ")).alias("s"), text.unfenced(F.lit('```json\n{"a": 1}\n```')).alias("u"), text.lead_summary(F.array(F.lit("x"), F.lit(""), F.lit("x"), F.lit("y")), F.array(F.lit(" "), F.lit(" ev "))).alias("l"),
    ).first()
    assert (row["m"], row["c"], row["e"], row["s"], row["u"], row["l"]) == (0.5, 0.5, pytest.approx(4 / 7), "A b", '{"a": 1}', "x, y. ev")


def test_ids(spark):
    names = ["Server", "LoadBalancer", "Éà ß"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.stable_id("cls", "n").alias("i")).collect()
    for r in rows:
        assert r["i"] == "cls_" + uuid.uuid5(uuid.NAMESPACE_DNS, f"cls:{r['n'].lower()}").hex[:12]
    got = spark.range(1).select(ids.community_id(F.lit(1), F.lit(2), F.array(F.lit("b"), F.lit("a"))).alias("c")).first()["c"]
    assert got == "cm_1_" + hashlib.sha1(b"1:2:a,b").hexdigest()[:12]


def plain_embedding(t, dim):
    v = [0.0] * dim
    p = f"  {t.lower()}  "
    for i in range(len(p) - 2 if t else 0):
        h = hashlib.sha256(p[i : i + 3].encode()).digest()
        v[int(h[:4].hex(), 16) % dim] += 2.0 * (h[4] % 2) - 1.0
    length = math.hypot(*v)
    return [x / length for x in v] if length else v


def test_embeddings(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for r in vectors.with_embeddings(df, ["i"], "t", 32).collect():
        assert r["embedding"] == pytest.approx(plain_embedding(r["t"], 32), abs=1e-12)
    with pytest.raises(ValueError):
        vectors.hashed_buckets(df, ["i"], "t", 8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5), min_size=0, max_size=4), st.lists(st.floats(-5, 5), min_size=0, max_size=4))
def test_vectors(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    row = df.select(vectors.cosine("a", "b").alias("c"), vectors.lerp("a", "b", 0.4).alias("l"), vectors.normalised("a").alias("n")).first()
    n = min(len(a), len(b))
    length = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    want = 0.0 if n == 0 else max(0.0, min(1.0, sum(x * y for x, y in zip(a, b)) / (length(a[:n]) * length(b[:n]))))
    assert row["c"] == pytest.approx(want, abs=1e-9)
    assert row["l"] == pytest.approx([0.6 * x + 0.4 * y for x, y in zip(a, b)])
    assert row["n"] == pytest.approx([x / length(a) for x in a])


def test_tasks_follow_the_size_of_the_input(spark, tmp_path, monkeypatch):
    from factloom.plans import sizing

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.range(20_000).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    try:
        sizing.scaled(rows)
        assert {n: spark.conf.get(n) for n in names} == before  # small tables change nothing
        monkeypatch.setattr(sizing, "BYTES_A_PARTITION", 4096)
        monkeypatch.setattr(sizing, "BYTES_A_TASK", 8192)
        sizing.scaled(rows)
        assert int(spark.conf.get(names[0])) > 10 and spark.conf.get(names[1]) == "8192b"
        spark.conf.set(names[0], 1000)
        sizing.scaled(rows)
        assert spark.conf.get(names[0]) == "1000"  # never lowered
        dealt = sizing.dealt(rows, ["id"], 2_000)
        assert dealt.rdd.getNumPartitions() == 10
        plan = dealt.groupBy("id", (dealt.id % 2).alias("x")).count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_multisets_of_long_texts(spark):
    """Equal to counting words, at any length in time about proportional to it."""
    rng = random.Random(2)
    texts = [(" ".join(rng.choices("a b c d É é".split(), k=rng.randrange(9))), " ".join(rng.choices("a b c e É".split(), k=rng.randrange(9)))) for _ in range(60)]
    texts.append((" ".join(f"w{rng.randrange(9000)}" for _ in range(12_000)), " ".join(f"w{rng.randrange(9000)}" for _ in range(12_000))))
    began = time.perf_counter()
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, a string, b string").select("i", text.multiset_jaccard("a", "b").alias("j")).collect()
    assert time.perf_counter() - began < 15
    for r in rows:
        a, b = (Counter(t.lower().split()) for t in texts[r["i"]])
        assert r["j"] == pytest.approx(sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0)


def test_equal_values_are_computed_once(spark):
    from factloom.plans import sizing

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def long(x):
        seen.add(1)
        return len(x or "")

    rows = spark.createDataFrame([(i, "ab" * (i % 3) if i % 4 else None) for i in range(200)], "i int, x string")
    got = sizing.once(rows, ["x"], {"n": long("x")}, 2).collect()
    assert len(got) == 200 and all(r["n"] == len(r["x"] or "") for r in got) and seen.value == 4
