import json
import logging

import pytest
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.operators import communities, graph, measures, retrieval, verification
from factloom.sources.documents import EngineSettings

LINES = ["Web One routes to Db One.", "Web Two routes to Db One.", "Web Three routes to Db Two.", "Lb One routes to Web One.", "Lb One routes to Web Two."]


def parts():
    """Made here, as workers can't import this file."""

    def proposer(text):
        machine = {"name": "Machine", "description": "", "parent_names": [], "aliases": []}
        link = {"name": "routesTo", "description": "", "domain": "Machine", "range": "Machine", "direction": "directed", "symmetric": False, "transitive": False}
        return {"entity_types": [machine], "relations": [link], "notes": ""}

    def client(prompt, heat):
        text = prompt.splitlines()[-1]
        if "Three" in text and heat:
            raise RuntimeError("busy")
        head, tail = text.rstrip(".").split(" routes to ")
        entity = lambda n: {"name": n, "type_name": "machine", "description": "", "aliases": []}
        return json.dumps({"entities": [entity(head), entity(tail)], "triples": [{"head": head, "relation": "RoutesTo", "tail": tail, "evidence": f"{head} routes to {tail}", "confidence": 0.9}], "notes": ""})

    return proposer, client


@pytest.fixture(scope="module")
def engine(spark):
    proposer, client = parts()
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(LINES)], "doc_id string, text string")
    made = Engine(spark, EngineSettings(chunk_size=50, chunk_overlap=5, hierarchy_levels=2, beam_width=2), detector=communities.louvain)
    made.run(docs, client, proposer)
    made.tables["documents"] = docs
    return made


def test_documents_to_report(engine):
    t = engine.tables
    assert t["classes"].count() == t["relations"].count() == 1
    assert t["pool"].count() == 14 and [r["error"] for r in t["failed"].collect()] == ["RuntimeError: busy"]
    assert t["entities"].count() == 6 and t["verified_entities"].count() == 6
    kept = t["triples"].select("head_id", "relation_id", "tail_id").distinct()
    assert kept.count() == 5 and {r["filter_tag"] for r in t["decisions"].collect()} == {"F1_consensus"}
    report = engine.ask("where does Web Three route to")
    assert report.startswith("Query: where does Web Three") and "Web Three routes to Db Two" in report
    assert engine.search(engine.spark.createDataFrame([(7, "Lb One")], "query_id long, raw_query string"))["entities"].count() == 2
    with pytest.raises(ValueError, match="index"):
        Engine(engine.spark).search(None)


def test_one_document_and_graph(engine):
    proposer, client = parts()
    t = engine.tables
    other = Engine(engine.spark)
    entities, triples = other.extract_one("x", "A One routes to B Two.", t["classes"], t["relations"], client)
    assert entities.count() == 2 and triples.count() == 3
    docs = engine.spark.createDataFrame([("x", "A One routes to B Two.")], "doc_id string, text string")
    nodes, edges = other.verify_to_graph(triples, docs, entities, t["classes"], t["relations"])
    assert {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()} == {"class": 1, "relation": 1, "entity": 2}
    assert edges.filter("kind = 'triple'").count() == 3
    tree = t["communities"]
    more, links = graph.with_communities(nodes, edges, tree)
    assert more.filter("kind = 'community'").count() == tree.count() and links.filter("kind = 'part_of'").count() == tree.filter("parent_id IS NOT NULL").count()
    typed = graph.typed_graph(t["triples"], t["verified_entities"], 0.5)
    assert typed.count() == 5 and typed.agg(F.max("weight")).first()[0] == 3 and graph.typed_graph(t["triples"], t["verified_entities"], 0.95).count() == 0
    base = (t["classes"], t["relations"])
    assert other.induce(docs, proposer, base)[0].count() == 1


def test_tiers_in_order(spark):
    rows = [("ok", "a", "r", "b", "long enough", 0.9, 0.5), ("loop", "a", "r", "a", "long enough", 0.9, 0.5), ("type", "b", "r", "a", "long enough", 0.9, 0.5), ("weak", "a", "r", "b", "long enough", 0.6, 0.1)]
    scored = spark.createDataFrame(rows, "triple_id string, head_id string, relation_id string, tail_id string, evidence string, eb_total double, ec_total double")
    entities = spark.createDataFrame([("a", "cls_a"), ("b", "cls_b")], "entity_id string, type_id string")
    relations = spark.createDataFrame([("r", "cls_a", "cls_b")], "relation_id string, domain string, range string")
    up = spark.createDataFrame([("cls_a", "cls_a"), ("cls_b", "cls_b")], "class_id string, ancestor_id string")
    got = {r["triple_id"]: (r["tier_levels"], r["accepted"], r["level_reached"], r["rejected_reason"]) for r in verification.tier_cascade(scored, entities, relations, up).collect()}
    assert got == {
        "ok": (["syntactic", "semantic", "evidential"], True, "evidential", None), "loop": ([], False, None, "syntactic"),
        "type": (["syntactic"], False, "syntactic", "semantic"), "weak": (["syntactic", "semantic"], False, "semantic", "evidential"),
    }
    assert verification.tier_cascade(scored, entities, relations, up, ("syntactic",)).filter("accepted").count() == 3
    with pytest.raises(ValueError):
        verification.tier_cascade(scored, entities, relations, up, ("other",))


def test_hops(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 3), ("c", "d", 1)], "src string, dst string, weight long")
    seeds = spark.createDataFrame([(1, "a", 1.0), (2, "d", 0.5)], "query_id long, node string, score double")
    got = {(r["query_id"], r["node"]): (r["hop"], r["score"]) for r in retrieval.hop_expansion(edges, seeds, 2).collect()}
    assert got == {(1, "a"): (0, 1.0), (1, "b"): (1, 0.5), (1, "c"): (2, 0.1875), (2, "d"): (0, 0.5), (2, "c"): (1, 0.25), (2, "b"): (2, 0.09375)}


def test_counters_and_log(spark):
    counters = measures.Counters()
    counters.count(spark.range(10), "seen", "id").collect()
    assert counters.snapshot("seen") == {"seen": {"rows": 10, "total": 45}}
    log = measures.set_up_log("DEBUG", as_json=True)
    assert measures.set_up_log("INFO", as_json=True) is log and len(log.handlers) == 1
    line = log.handlers[0].format(logging.LogRecord("factloom.x", logging.INFO, "", 0, "n %d", (3,), None))
    assert json.loads(line) == {"level": "INFO", "logger": "factloom.x", "message": "n 3"}
