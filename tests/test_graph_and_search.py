import itertools
import random
import time
import xml.etree.ElementTree as tree

import pytest
from pyspark.sql import functions as F

from factloom.functions import vectors
from factloom.operators import alignment, communities, graph, measures, retrieval
from factloom.sources import documents, snapshots

KINDS = {"lb": "load balancer", "web": "web server", "db": "database", "cache": "cache node"}
LINKS = {"routes to": "lb1-web1 lb1-web2 lb2-web3", "reads": "web1-db1 web2-db2 web3-db1", "uses": "web1-cache1 web2-cache2"}


def named(node):
    return f"{KINDS[node.rstrip('123')]} {node[-1]}"


@pytest.fixture(scope="module")
def plant(spark):
    """Nine machines and eight verified facts."""
    links = [(*pair.split("-"), verb) for verb, pairs in LINKS.items() for pair in pairs.split()]
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    entities = spark.createDataFrame([(f"e_{n}", named(n), None, i) for i, n in enumerate(nodes)], "entity_id string, name string, type_id string, ord long")
    facts = [(f"t_{i}", f"e_{a}", "rel_conn", f"e_{b}", f"{named(a)} {verb} {named(b)}", True, i) for i, (a, b, verb) in enumerate(links)]
    return entities, spark.createDataFrame(facts, "triple_id string, head_id string, relation_id string, tail_id string, evidence string, is_verified boolean, ord long")


def test_known_search_scores(spark, plant):
    """Values recomputed by hand from the scoring formulas for a given partition."""
    entities, facts = plant
    groups = [["cache1", "lb1", "web1"], ["cache2", "db2", "web2"], ["db1", "lb2", "web3"]]
    rows = [(f"c{i}", 0, i, [f"e_{n}" for n in g], "top", []) for i, g in enumerate(groups)]
    rows.append(("top", 1, 0, sorted(f"e_{n}" for g in groups for n in g), None, ["c0", "c1", "c2"]))
    given = spark.createDataFrame(rows, "community_id string, level int, ord int, entity_ids array<string>, parent_id string, child_ids array<string>")
    noted = communities.annotated(given, entities, facts)
    top = noted.filter("level = 1").first()["summary"]
    assert top.startswith("cache node 1, cache node 2, database 1") and top.endswith("web server 3. web server 1 uses cache node 1")
    index = retrieval.build_index(noted, entities, facts)
    asked = spark.createDataFrame([(1, "which load balancer routes to web server"), (2, "cache node usage for web server"), (3, "database reads")], "query_id long, raw_query string")
    found = retrieval.search(index, asked)

    def best(part, key, q):
        return [(r[key], round(r["score"], 6)) for r in found[part].filter(f"query_id = {q}").orderBy("rank").collect()]

    assert best("coarse", "community_id", 1) == [("top", 0.448107)]
    assert best("medium", "community_id", 1) == [("c2", 0.443839), ("c0", 0.441465), ("c1", 0.381689)]
    assert best("entities", "entity_id", 1) == [("e_lb2", 0.434282), ("e_lb1", 0.433095), ("e_web1", 0.412592)]
    assert best("triples", "triple_id", 1) == [("t_0", 0.616091), ("t_1", 0.609443), ("t_2", 0.604246)]
    assert best("coarse", "community_id", 2) == [("top", 0.495533)]
    assert best("triples", "triple_id", 2) == [("t_7", 0.567782), ("t_6", 0.54761), ("t_1", 0.386419)]
    assert best("medium", "community_id", 3) == [("c2", 0.214866), ("c1", 0.158333), ("c0", 0.133333)]
    assert best("triples", "triple_id", 3) == [("t_3", 0.322137), ("t_5", 0.318437), ("t_4", 0.294167)]
    trace = retrieval.beam_trace(found).filter("query_id = 1").collect()
    assert sorted({r["stage"] for r in trace}) == [1, 2, 3] and all(len(r["kept"]) <= 3 for r in trace)
    report = {r["query_id"]: r["report"] for r in retrieval.reports(index, asked, found).collect()}
    assert report[1].startswith("Query: which load balancer") and "triple 0.616" in report[1]


def test_hierarchy_of_the_plant(spark, plant):
    entities, facts = plant
    edges = graph.entity_graph(facts, entities)
    tree = communities.hierarchy(edges, entities.select(F.col("entity_id").alias("node")))
    rows = tree.collect()
    bottom = [r for r in rows if r["level"] == 0]
    assert len(bottom) == 3 and sorted(x for r in bottom for x in r["entity_ids"]) == sorted(r["entity_id"] for r in entities.collect())
    q = graph.modularity(edges, tree.filter("level = 0").select(F.explode("entity_ids").alias("node"), F.col("community_id").alias("community"))).first()[0]
    assert q == pytest.approx(0.4140625)
    assert communities.roots(tree).count() == 1
    ids = {r["community_id"] for r in rows}
    assert all(r["parent_id"] is None or r["parent_id"] in ids for r in rows)  # nobody points at a dropped level
    assert communities.walk(tree).count() == len(rows)
    assert communities.children_of(tree, communities.roots(tree)).count() == 3
    found = retrieval.search(retrieval.build_index(communities.annotated(tree, entities, facts), entities, facts), spark.createDataFrame([(1, "cache")], "query_id long, raw_query string"))
    assert found["triples"].count() == 3


def plain_greedy(pairs, total):
    groups = {x: [x] for p in pairs for x in p}
    while True:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            links = sum((x in groups[a] and y in groups[b]) or (x in groups[b] and y in groups[a]) for x, y in pairs)
            if links:
                degree = lambda g: sum((x in groups[g]) + (y in groups[g]) for x, y in pairs)
                gain = 2 * total * links - degree(a) * degree(b)
                if best is None or gain > best[0]:
                    best = (gain, a, b)
        if best is None or best[0] < 0:
            return sorted(sorted(g) for g in groups.values())
        _, a, b = best
        groups[a] += groups.pop(b)


@pytest.mark.parametrize("seed", range(8))
def test_greedy_merging_equals_plain_search(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(10)]
    pairs = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(14)})
    assert sorted(communities.greedy_groups(pairs, len(pairs))) == plain_greedy(pairs, len(pairs))


def test_greedy_merging_of_hubs_and_repeated_links():
    """Many hubs, loops and repeats, against plain search; large stars in time that doesn't grow with their square."""
    for seed in range(20):
        rng = random.Random(seed)
        nodes = [f"n{i}" for i in range(9)]
        pairs = [(nodes[0] if rng.random() < 0.4 else rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(1, 25))]
        pairs = [p for p in pairs if p[0] != p[1]] or [("n0", "n1")]
        assert sorted(communities.greedy_groups(pairs, len(pairs) + 3)) == plain_greedy(pairs, len(pairs) + 3)
    stars = [(f"hub{h}", f"leaf{h}_{i}") for h in range(3) for i in range(20_000)] + [("hub0", "hub1"), ("hub1", "hub2")]
    began = time.process_time()
    assert sorted(map(len, communities.greedy_groups(stars, len(stars)))) == [20_001] * 3
    assert time.process_time() - began < 20


def test_edgeless_and_components_and_fallback(spark):
    none = spark.createDataFrame([], "src string, dst string, weight long")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert communities.detect(none, nodes, 0).first()["members"] == ["a", "b"]
    assert communities.detect(none, nodes.limit(1), 0).count() == 0
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1), ("z", "z", 1)], "src string, dst string, weight long")
    got = [r["members"] for r in communities.detect(edges, nodes, 0, 1).orderBy("ord").collect()]
    assert got == [["a", "b", "c"], ["x", "y"], ["z"]]
    with pytest.raises(ValueError, match="louvain"):
        communities.greedy(edges.select("src", "dst"), max_edges=1)
    for detector in (communities.labels, communities.louvain):
        got = [r["members"] for r in communities.detect(edges, nodes, 0, 1, detector).orderBy("ord").collect()]
        assert got == [["a", "b", "c"], ["x", "y"], ["z"]]
    for bad in ({"levels": 0}, {"parent_blend": 2}, {"dim": 8}):
        with pytest.raises(ValueError):
            communities.HierarchySettings(**bad)
    with pytest.raises(ValueError):
        retrieval.SearchSettings(k=0)


def test_louvain_is_as_good_as_greedy_merging(spark):
    rng = random.Random(5)
    block = lambda i: f"n{i:02}"
    pairs = {tuple(sorted((block(a), block(b)))) for a in range(60) for b in range(a) if rng.random() < (0.5 if a // 12 == b // 12 else 0.02)}
    pairs |= {("hub", f"leaf{i}") for i in range(30)} | {("hub", "n00")}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string").withColumn("weight", F.lit(1))
    value = lambda detector: graph.modularity(edges, detector(edges.select("src", "dst"))).first()[0]
    good = value(communities.louvain)
    assert good >= 0.98 * value(communities.greedy) and good > 0.5
    found = {r["node"]: r["community"] for r in communities.louvain(edges.select("src", "dst")).collect()}
    assert len(found) == 91 and len({found["hub"], *(found[f"leaf{i}"] for i in range(30))}) == 1


def test_louvain_moves_numbers(spark, monkeypatch):
    """Rounds carry numbers, not ids; loops and nodes without links stay what they are, and nothing stays cached."""
    seen = []
    monkeypatch.setattr(communities, "materialise", lambda df, name, keep=communities.materialise: seen.append((name, df.schema)) or keep(df, name))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("z", "z"), ("f", "f")], "src string, dst string")
    got = {r["node"]: r["community"] for r in communities.louvain(edges).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"] and got["z"] == "z" and set(got.values()) <= set(got)
    rounds = [schema for name, schema in seen if name in ("moves", "links", "degrees")]
    assert rounds and all(f.dataType.simpleString() in ("bigint", "boolean") for schema in rounds for f in schema)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_reports_read_no_whole_table(spark, plant, tmp_path):
    """Labels come from the hits: neither facts nor entities are read again."""
    entities, facts = plant
    for name, rows in (("entities", entities), ("facts", facts)):
        rows.write.parquet(str(tmp_path / name))
    entities, facts = (spark.read.parquet(str(tmp_path / name)) for name in ("entities", "facts"))
    tree = communities.hierarchy(graph.entity_graph(facts, entities), entities.select(F.col("entity_id").alias("node")), detector=communities.louvain)
    index = retrieval.build_index(communities.annotated(tree, entities, facts), entities, facts, stored=False)
    asked = spark.createDataFrame([(1, "which load balancer routes to web server")], "query_id long, raw_query string")
    found = retrieval.search(index, asked)
    report = retrieval.reports(index, asked, found)
    assert "triple 0." in report.first()["report"] and "(e_" in report.first()["report"]
    read = found["triples"].inputFiles() + report.inputFiles()
    assert not [f for f in read if "/facts/part-" in f and str(tmp_path) in f]


def test_search_with_other_parts(spark, plant):
    """An expander, an own embedder and summariser, and an index that embeds only what a search meets."""
    entities, facts = plant
    tree = communities.hierarchy(graph.entity_graph(facts, entities), entities.select(F.col("entity_id").alias("node")), detector=communities.louvain)
    noted = communities.annotated(tree, entities, facts, summariser=lambda names, evidence: F.array_join(names, " and "))
    assert all(" and " in r["summary"] for r in noted.collect())
    asked = spark.createDataFrame([(1, "cache")], "query_id long, raw_query string")
    score = lambda found: [(r["query_id"], r["triple_id"], r["score"]) for r in found["triples"].orderBy("rank").collect()]
    stored, lazy = retrieval.build_index(noted, entities, facts), retrieval.build_index(noted, entities, facts, stored=False)
    assert score(retrieval.search(stored, asked)) == score(retrieval.search(lazy, asked))
    wider = retrieval.search(lazy, asked, expander=lambda q: F.array(q, F.lit("database reads")))
    assert score(wider) != score(retrieval.search(lazy, asked)) and {t for _, t, _ in score(wider)} & {"t_3", "t_4", "t_5"}
    count = lambda df, keys, text, name: df.withColumn(name, vectors.normalised(F.array(F.length(text).cast("double"), F.lit(1.0))))
    own = retrieval.build_index(communities.annotated(tree, entities, facts, embedder=count), entities, facts, embedder=count, stored=False)
    assert len(score(retrieval.search(own, asked))) == 3


def test_near_duplicates_stay_within_a_relation(spark):
    rows = [("A", "r1"), ("B", "r2"), ("C", "r2")]
    facts = spark.createDataFrame([(i, "h", r, "t", "one two three four five") for i, r in rows], "triple_id string, head_id string, relation_id string, tail_id string, evidence string")
    assert [(r["a"], r["b"]) for r in alignment.near_duplicate_triples(facts).collect()] == [("B", "C")]


def test_graph_tables(spark, plant):
    entities, facts = plant
    few = spark.createDataFrame([("e_db1",)], "entity_id string")
    assert sorted(r["triple_id"] for r in graph.triples_of(facts, few).collect()) == ["t_3", "t_5"]
    assert "BroadcastNestedLoopJoin" not in graph.triples_of(facts, few)._jdf.queryExecution().executedPlan().toString()
    assert graph.triples_between(facts, "e_web1", "e_db1").count() == 1
    near = graph.neighbours_within(graph.entity_graph(facts, entities), few.withColumnRenamed("entity_id", "node"), 2)
    assert {r["node"]: r["distance"] for r in near.collect()} == {"e_db1": 0, "e_web1": 1, "e_web3": 1, "e_lb1": 2, "e_cache1": 2, "e_lb2": 2}


@pytest.mark.parametrize("fmt", snapshots.FORMATS)
def test_graph_files(spark, plant, tmp_path, fmt):
    entities, facts = plant
    e = entities.withColumn("type_id", F.lit("cls_m")).withColumn("description", F.lit('quote " < & \n é')).withColumn("confidence", F.lit(1.0))
    classes = spark.createDataFrame([("cls_m", "Machine", "", [], [])], "class_id string, name string, description string, parent_ids array<string>, aliases array<string>")
    relations = spark.createDataFrame([("rel_conn", "connectsTo", "", "cls_m", "cls_m", "directed")], "relation_id string, name string, description string, domain string, range string, direction string")
    nodes, edges = graph.property_graph(classes, relations, e, facts.withColumn("strategy", F.lit("tot")).withColumn("confidence", F.lit(0.5)))
    path = str(tmp_path / "g")
    snapshots.save_graph(nodes, edges, path, fmt)
    n, d = snapshots.load_graph(spark, path, fmt)
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(ValueError):
        snapshots.save_graph(nodes, edges, path, "gexf2")


@pytest.mark.parametrize("fmt", ["graphml", "gexf"])
def test_graph_files_of_many_parts_and_splits(spark, tmp_path, fmt):
    """Parts, and splits of parts, that begin in the middle of a document."""
    odd = ["plain", "  spaces  ", 'a "b" <c> & &amp; d', "line\nbreak\r\nreturn\r", "", "é </data> <node "]
    nodes = spark.createDataFrame([(f"n{i}", "entity", odd[i % len(odd)], '{"x":"%d"}' % i) for i in range(3000)], "id string, kind string, label string, attributes string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7) % 3000}", "triple", f"{odd[i % 5]}{i}", "{}") for i in range(3000)], "src string, dst string, kind string, key string, attributes string")
    path, held = str(tmp_path / "g"), {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        snapshots.save_graph(nodes, edges, path, fmt)
        parts = sorted(p for p in (tmp_path / "g").iterdir() if p.name.startswith("part-"))
        assert len(parts) > 2
        elements = tree.fromstring("".join(p.read_bytes().decode() for p in parts)).iter()
        assert sum(x.tag.split("}")[1] in ("node", "edge") for x in elements) == 6000
        n, e = snapshots.load_graph(spark, path, fmt)
        assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
        assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_snapshot_and_readers(spark, plant, tmp_path):
    entities, facts = plant
    path = str(tmp_path / "snap")
    snapshots.save_snapshot({"entities": entities, "triples": facts}, path, 3)
    tables, version = snapshots.load_snapshot(spark, path)
    assert version == 3 and tables["triples"].count() == 8 and set(tables) == {"entities", "triples"}
    with pytest.raises(ValueError):
        snapshots.save_snapshot({"other": entities}, path)
    lines = str(tmp_path / "docs.jsonl")
    with open(lines, "w") as f:
        f.write('{"doc_id": "a", "text": "x"}\n{"text": "y"}\n{"doc_id": "c", "text": " "}\n')
    rows = documents.load_documents(spark, lines).collect()
    assert len(rows) == 2 and all(r["doc_id"] for r in rows)
    documents.write_json(entities, str(tmp_path / "out"))
    assert documents.read_jsonl(spark, str(tmp_path / "out")).count() == 9
    (tmp_path / "one.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert documents.read_json(spark, str(tmp_path / "one.json"), "a int").count() == 2
    assert [tuple(r) for r in documents.from_texts(spark, ["a", ("k", "b")]).collect()] == [("doc_0", "a"), ("k", "b")]
    (tmp_path / "s.json").write_text('{"chunk_size": 10, "strategies": ["tot"], "odd": 1}')
    settings = documents.load_settings(str(tmp_path / "s.json"))
    assert (settings.chunk_size, settings.strategies, settings.extras) == (10, ("tot",), {"odd": 1})


def test_overlap_join_loses_no_pair(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(1, 9))) for _ in range(120)] + ["w1 w2 w3"] * 4 + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for threshold in (0.5, 0.7, 1.0):
        sets = [frozenset(t.split()) for t in texts]
        want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
        got = {(r["a"], r["b"]) for r in alignment.prefix_pairs(df, "id", "t", threshold).collect()}
        rep = {}
        for i, s in enumerate(sets):
            rep.setdefault(s, i)
        assert got <= want
        assert {(i, j) for i, j in want if rep[sets[i]] == i and (rep[sets[j]] == j or sets[i] == sets[j])} == got


def test_vector_pairs_recall(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i * 10 + k, [x + rng.gauss(0, 0.25) for x in b]) for i, b in enumerate(base) for k in range(4)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) >= 0.85}
    got = {(r["a"], r["b"]) for r in alignment.similar_vectors(df, "id", "v").collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 50


def test_vector_pairs_are_all_found(spark):
    """Pairs just above the threshold, vectors of other lengths, and rows without one."""
    rng = random.Random(6)
    rows = []
    for i in range(0, 3000, 2):
        a, b = ([rng.gauss(0, 1) for _ in range(64)] for _ in range(2))
        norm = sum(x * x for x in a) ** 0.5
        a = [x / norm for x in a]
        along = sum(x * y for x, y in zip(a, b))
        b = [y - along * x for x, y in zip(a, b)]
        norm = sum(x * x for x in b) ** 0.5
        rows += [(i, a), (i + 1, [0.86 * x + (1 - 0.86**2) ** 0.5 * y / norm for x, y in zip(a, b)])]
    odd = [(9000, rows[0][1][:8]), (9001, rows[0][1][:8]), (9002, None), (9003, []), (9004, [0.0] * 64)]
    df = spark.createDataFrame(rows + odd, "id int, v array<double>")
    got = {(r["a"], r["b"]): r["cosine"] for r in alignment.similar_vectors(df, "id", "v").collect()}
    assert {(i, i + 1) for i in range(0, 3000, 2)} | {(0, 9000), (0, 9001), (9000, 9001)} <= set(got)
    assert got[0, 9000] == pytest.approx(1.0) and min(got.values()) >= 0.85 and all(b < 9002 for _, b in got)
    assert "sortmergejoin" not in alignment.similar_vectors(df, "id", "v")._jdf.queryExecution().executedPlan().toString().lower()


def test_vector_ranking_by_blocks(spark):
    """Scaled copies tie and go by id; short, empty and missing vectors score as cosines do; no row is compared by the planner."""
    rng = random.Random(8)
    v = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(f"i{i:02}", [x * (i + 1) / 7 for x in v]) for i in range(40)] + [("n", None), ("e", []), ("s", [-x for x in v[:3]])]
    items = spark.createDataFrame(rows, "item string, embedding array<double>")
    asked = spark.createDataFrame([(1, v), (2, [])], "query_id int, embedding array<double>")
    found = retrieval.vector_top_k(items, asked, 5, "item")
    got = [(r["query_id"], r["item_id"], r["score"], r["rank"]) for r in found.orderBy("query_id", "rank").collect()]
    assert [x[1:] for x in got[:5]] == [(f"i{i:02}", 1.0, i + 1) for i in range(5)]
    assert [x[1:3] for x in got[5:]] == [("e", 0.0), ("i00", 0.0), ("i01", 0.0), ("i02", 0.0), ("i03", 0.0)]
    assert retrieval.vector_top_k(items, asked, 100, "item").count() == 2 * 43 and not retrieval.vector_top_k(items.limit(0), asked, 5, "item").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bm25_sums_where_the_document_is(spark):
    """Scores of a document and all queries aren't shuffled by query, and no term's counts go to one task."""
    docs = spark.createDataFrame([(i, f"the the word{i % 7} and word{i % 3}") for i in range(50)] + [(99, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(q, f"the word{q} and the") for q in range(5)], "query_id int, raw_query string")
    scores = retrieval.bm25(docs, asked)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(term" not in plan
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in scores.collect()}
    assert len(got) == 250 and got[2, 2] > got[2, 3] and got[4, 4] == pytest.approx(got[4, 11])


def test_bm25_histogram_and_mixing(spark):
    docs = spark.createDataFrame([(1, "red red apple"), (2, "green pear tree and leaf"), (3, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(9, "red pear red")], "query_id int, raw_query string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs, asked).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0
    dense = spark.createDataFrame([(9, 1, 0.2), (9, 3, 1.0)], "query_id int, doc_id int, score double")
    mixed = {r["doc_id"]: r["score"] for r in retrieval.combined_ranking(dense, retrieval.bm25(docs, asked)).collect()}
    assert mixed[1] == pytest.approx(0.7 * 0.2 + 0.3) and mixed[3] == pytest.approx(0.7)
    h = measures.histogram(docs.withColumn("g", F.lit(1)), ["g"], "doc_id", (1, 2.5)).first()
    assert (h["count"], h["le_0"], h["le_1"]) == (3, 1, 2)
    rows, seen = measures.observed(docs, "n", "doc_id")
    rows.collect()
    assert seen.get == {"rows": 3, "total": 6}
