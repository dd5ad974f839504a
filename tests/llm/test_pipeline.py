import random

import corpus_pipeline
from test_decontamination import plain as plain_hits
from test_mixing import fill, systematic
from test_quality import plain as plain_features
from test_quality import plain_verdicts
from test_simhash import plain_components, plain_print


def test_run_equals_brute_force(spark, make_docs, tmp_path):
    rng = random.Random(8)
    item = " ".join(f"b{i}" for i in range(15))
    texts = []
    for i in range(60):
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 140))]
        if i % 10 == 3:
            body[20:20] = item.split()
        texts.append(" ".join(body))
    texts += texts[:8] + ["too short", None, "a b c " * 50, ""]
    docs = make_docs(texts, clash=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    kept = []
    for i, t in enumerate(texts):
        f = plain_features(t)
        if f[0] >= 50 and 100 * f[4] <= 50 * f[0]:  # too few labels to certify a cutoff: base rules only
            kept.append(i)
    groups = plain_components([plain_print(texts[i]) for i in kept])
    kept = [i for k, i in enumerate(kept) if groups[k] == k]
    kept = [i for i, hits in zip(kept, plain_hits([texts[i] for i in kept], [(1, item)]), strict=True) if not hits[4]]
    rows = [(i, source[i], len(texts[i].split())) for i in kept]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    copies = systematic(rows, fill(sizes), sizes)

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "virtual_slot", "shard", "map_version"]
    got = out.collect()
    counts = {}
    for r in got:
        assert r["text"] == texts[r["doc_id"]]
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {i: c for i, c in copies.items() if c}
    # A slot has one shard; each largest slot went to the lightest shard.
    loads, shard_of = {}, {}
    for r in got:
        loads[r["virtual_slot"]] = loads.get(r["virtual_slot"], 0) + len(r["text"].encode()) + 1
        assert shard_of.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    total = [0] * 16
    for slot in sorted(loads, key=lambda s: (-loads[s], s)):
        lightest = min(range(16), key=lambda s: (total[s], s))
        assert shard_of[slot] == lightest
        total[lightest] += loads[slot]


def test_certified_cutoffs_take_effect(spark, make_docs, tmp_path):
    """Labels enough for a cutoff: loud documents without a label go too."""
    rng = random.Random(3)
    good = [" ".join(f"w{rng.randrange(5000)}" for _ in range(70)) for _ in range(700)]
    loud = [" ".join(f"w{rng.randrange(5000)}###" for _ in range(70)) for _ in range(80)]
    docs = make_docs([*good, *loud], clash=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 700), 0) for i in range(780) if i < 690 or i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want, cuts = plain_verdicts([(i, t, ["en", "de", None][i % 3]) for i, t in enumerate([*good, *loud])], [(i, q) for i, q, _ in labels])
    assert len(cuts) == 3
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [i for i in sorted(want) if want[i]] == list(range(700))


def test_odd_rows(spark, make_docs, tmp_path):
    rng = random.Random(5)
    body = [" ".join(f"w{rng.randrange(5000)}" for _ in range(70)) for _ in range(8)]
    texts = [*body, *body[:4], None, "", body[0] + " x" * 40 + " y" * 0, "w " * 200_000]
    docs = make_docs(texts, ids=[None, 1, 1, None, 3, 3, 4, None, 1, 1, 2, None, None, 5, 6, 7]).withColumnsRenamed({"size": "_row", "fp": "Shard"})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None), (1, "of few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["text"] for r in out} <= set(body) | {texts[14]} and len(out) >= 8
    assert all(texts[r["_row"]] == r["text"] for r in out)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_columns(spark, sample):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    docs = sample
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == sample.columns
