import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction, ontology
from factloom.schemas import OUTPUTS, PROPOSALS, violations
from factloom.sources import chat_models


def plain_chunks(t, size, overlap):
    w = t.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)]


@pytest.mark.parametrize(("size", "overlap"), [(3, 0), (3, 1), (3, 2), (1000, 100)])
def test_chunks(spark, size, overlap):
    texts = ["a " * 5000, "one two three four five six", "x", "  ", "", None, " a b\n\tc  d "]
    if size == 3:
        texts = texts[1:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in ontology.chunks(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: plain_chunks(t, size, overlap) for i, t in enumerate(texts) if t and t.strip()}


def test_chunk_sizes_are_checked(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            ontology.chunks(df, *bad)


def proposals(spark):
    c = lambda n, d="", p=(), a=(): (n, d, list(p), list(a))
    r = lambda n, dom, rng, direction="directed", s=False: (n, "", dom, rng, direction, s, False)
    rows = [
        ("d1", 0, ([c("Server"), c(" Load  Balancer", "spreads", ["Server", " "], ["LB"])], [r("routesTo", "load balancer", "Server")], "")),
        ("d1", 1, ([c("server", "hosts", ["Nowhere"]), c("Rare"), c("")], [r("routesto", None, " ", "undirected", True)], "")),
        ("d2", 0, ([c("Load Balancer", "other", ["server"], ["LB", "balancer"])], [r("once", "Server", "Ghost")], "")),
        ("d3", 0, None),
    ]
    return spark.createDataFrame(rows, PROPOSALS)


def test_induction(spark):
    classes, relations = ontology.induce(proposals(spark), min_class_support=2)
    got = {r["name"]: r for r in classes.collect()}
    assert set(got) == {"Server", "Load  Balancer"}
    assert got["Server"]["description"] == "hosts" and got["Server"]["parent_ids"] == []
    assert got["Load  Balancer"]["parent_ids"] == [got["Server"]["class_id"]] and got["Load  Balancer"]["aliases"] == ["LB", "balancer"]
    rel = {r["name"]: r for r in relations.collect()}
    assert rel["routesTo"]["domain"] == got["Load  Balancer"]["class_id"] and rel["routesTo"]["range"] == got["Server"]["class_id"]
    assert rel["routesTo"]["direction"] == "undirected" and rel["routesTo"]["symmetric"] and rel["once"]["range"] is None
    kept = ontology.class_support(proposals(spark), compat=True)
    assert {r["key"]: r["support"] for r in kept.collect()} == {"Server": 1, "server": 1, "Load Balancer": 2, "Rare": 1}
    by_chunk = ontology.class_support(proposals(spark), distinct_chunks=True)
    assert {r["key"]: r["support"] for r in by_chunk.collect()} == {"server": 2, "load balancer": 2, "rare": 1}
    none = ontology.induce(proposals(spark).limit(0))
    assert none[0].count() == none[1].count() == 0


def test_proposing_with_a_rule_and_failures(spark):
    df = spark.createDataFrame([("d", 0, "Cats chase Mice. Cat chases Mouse"), ("d", 1, "boom")], "doc_id string, chunk_index int, text string")
    schema = PROPOSALS.split("reply ")[1].lower().replace(": ", ":")

    def rule(text):
        if text == "boom":
            raise RuntimeError("no reply")
        return ontology.capitalised_proposer(text)

    rows = {r["chunk_index"]: r for r in ontology.propose(df, rule, schema).collect()}
    assert rows[0]["reply"]["relations"][0]["name"] == "chases" and rows[0]["error"] is None
    assert rows[1]["reply"] is None and "no reply" in rows[1]["error"]
    assert "Part 1 of 2" in ontology.schema_prompt(df).filter("chunk_index = 0").first()["prompt"]


def test_lookup_extend_upsert_brief(spark):
    rows = spark.createDataFrame([(0, "a", "Server", ["host"]), (1, "b", "server ", None), (2, "c", "Host", [])], "ord int, id string, name string, aliases array<string>")
    assert {r["key"]: r["id"] for r in ontology.name_index(rows, "id").collect()} == {"server": "a", "host": "a"}
    assert {r["key"]: r["id"] for r in ontology.name_index(rows, "id", last=True).collect()} == {"server": "b", "host": "c"}
    other = rows.withColumn("id", F.concat("id", F.lit("b")).substr(1, 1)).unionByName(rows.select(F.lit(9).alias("ord"), F.lit("z").alias("id"), "name", "aliases").limit(1))
    assert sorted(r["id"] for r in ontology.extended(rows, other, "id").collect()) == ["a", "b", "c", "z"]
    assert ontology.upserted(rows.withColumn("k", F.lit(1)), "k", "ord").first()["id"] == "c"
    classes, relations = ontology.induce(proposals(spark), min_class_support=2)
    brief = ontology.schema_brief(classes, relations).first()["brief"]
    assert "- Load  Balancer is-a Server" in brief and "- once: Server → ?" in brief


def outputs(spark):
    e = lambda n, t="": (n, t, "", [])
    f = lambda h, r, t: (h, r, t, f"{h} {r} {t}", 0.9)
    rows = [
        ("d1", "tot", ([e("Web ", "Server"), e("web", "nothing")], [f("Web", "RoutesTo", "DB"), f("Web", "unknown", "DB"), f("", "routesTo", "DB")], "")),
        ("d1", "open_ie", ([e("web", "server")], [f("web", "routesto", "db"), f("many", "routesTo", "x")] + [f("a", "routesTo", str(i)) for i in range(100)], "")),
    ]
    return spark.createDataFrame(rows, OUTPUTS)


def test_extraction(spark):
    rel = spark.createDataFrame([("routesto", "rel_r")], "key string, id string")
    cls = spark.createDataFrame([("server", "cls_s")], "key string, id string")
    t = extraction.extracted_triples(outputs(spark), rel)
    assert {r["strategy"]: r["count"] for r in t.groupBy("strategy").count().collect()} == {"tot": 1, "open_ie": 80}
    first = t.filter("pos = 0").select("head_id", "tail_id").distinct().collect()
    assert len(first) == 1  # both strategies mint the same ids, so equal facts meet
    ents = {(r["strategy"], r["name"]): r for r in extraction.extracted_entities(outputs(spark), cls).collect()}
    assert ents["tot", "Web"]["type_id"] == "cls_s" and ents["tot", "Web"]["confidence"] == 0.8
    assert ents["tot", "DB"]["confidence"] == 0.5 and ("tot", "web") not in ents
    assert ("tot", "DB") not in {(r["strategy"], r["name"]) for r in extraction.extracted_entities(outputs(spark), cls, compat=True).collect()}


def test_merging(spark):
    e = spark.createDataFrame([("e1", "Web", None, "", ["a"], ["d1"], 0.5, 0), ("e2", "web ", "c", "x", ["b", "a"], ["d2", "d1"], 0.8, 1)], "entity_id string, name string, type_id string, description string, aliases array<string>, source_doc_ids array<string>, confidence double, ord long")
    (m,) = extraction.merged_entities(e).collect()
    assert (m["entity_id"], m["name"], m["aliases"], m["source_doc_ids"], m["confidence"]) == ("e1", "Web", ["a", "b"], ["d1", "d2"], 0.8)
    t = spark.createDataFrame([("t1", "h", "r", "x", "ab", ["d1"], "tot", 0.5, 0), ("t2", "h", "r", "x", "cde", ["d2"], "loose", 0.4, 1), ("t3", "h", "r", "x", "fgh", ["d1"], "loose", 0.9, 2)], "triple_id string, head_id string, relation_id string, tail_id string, evidence string, source_doc_ids array<string>, strategy string, confidence double, ord long")
    (m,) = extraction.merged_triples(t).collect()
    assert (m["triple_id"], m["evidence"], m["confidence"], m["source_doc_ids"], m["strategy"]) == ("t1", "cde", 0.9, ["d1", "d2"], "tot")
    mapping = extraction.canonical_map(e)
    out = extraction.canonicalised(t.withColumn("head_id", F.lit("e2")), mapping).collect()
    assert {(r["head_id"], r["tail_id"]) for r in out} == {("e1", "x")}


def test_prompts_and_model_replies(spark):
    docs = spark.createDataFrame([("d1", "web text"), ("d2", " ")], "doc_id string, text string")
    prompts = extraction.strategy_prompts(docs, "- Server")
    assert prompts.count() == 3 and set(r["strategy"] for r in extraction.strategy_tags(prompts).collect()) == {"tot", "open_ie", "loose"}
    with pytest.raises(ValueError):
        extraction.strategy_prompts(docs, "", ())
    asked = extraction.ask(prompts, lambda p, t: '{"x": 1}' if t else 1 / 0)
    assert {r["strategy"]: (r["raw"], r["error"] is None) for r in asked.collect()} == {"tot": (None, False), "open_ie": (None, False), "loose": ('{"x": 1}', True)}


def test_model_cache_and_repair(spark):
    requests = spark.createDataFrame([("m", "say a", 0.0), ("m", "say a", 0.0), ("m", "say b", 0.5), ("m", "nothing", 0.0)], "model string, prompt string, temperature double")
    make = chat_models.scripted([("could not be used", '{"v": 7}'), ("say a", '```json\n{"v": 1}\n```'), ("say b", '{"v": 2, "w": 3}')])
    cache = spark.createDataFrame([], "fingerprint string, reply string")
    rows, new = chat_models.cached_chat(requests, cache, make, "p1")
    assert rows.count() == 4 and new.count() == 2 and rows.filter("error IS NOT NULL").count() == 1
    known = spark.createDataFrame(new.collect(), "fingerprint string, reply string")
    again, fresh = chat_models.cached_chat(requests, known, chat_models.scripted([]), "p1")
    assert again.filter("reply IS NOT NULL").count() == 3 and fresh.count() == 0
    other, _ = chat_models.cached_chat(requests, known, chat_models.scripted([]), "p2")
    assert other.filter("reply IS NOT NULL").count() == 0  # the provider is part of the key
    parsed = chat_models.parsed(rows, "v int")
    assert {(r["prompt"], r["parsed"]["v"] if r["parsed"] else None) for r in parsed.collect()} == {("say a", 1), ("say b", None), ("nothing", None)}
    fixed = chat_models.repaired(requests.filter("prompt <> 'nothing'"), "v int", make)
    assert sorted(r["parsed"]["v"] for r in fixed.collect()) == [1, 1, 7]


def test_backend_choice():
    b = chat_models.default_backend({"OPENAI_API_KEY": "k", "OPENAI_MODEL": "m"})
    assert (b.style, b.model) == ("openai", "m")
    schema = chat_models.schema_of({"a": {"type": "string"}})
    assert b.response_format(schema)["type"] == "json_schema" and b.response_format(None) is None
    weak = chat_models.Backend("ollama", "http://127.0.0.1:9", "m", supports_schema=False, timeout=1)
    assert weak.response_format(schema) == "json" and not weak.ping()
    with pytest.raises(chat_models.ModelError):
        weak.chat([{"role": "user", "content": "x"}])
    with pytest.raises(chat_models.BackendUnavailable):
        chat_models.default_backend({"OLLAMA_HOST": "http://127.0.0.1:9"})


def test_field_rules(spark):
    df = spark.createDataFrame([(" ", 0.5, "tot"), ("x", 1.5, "tot"), ("x", 1.0, "odd"), ("x", 0.0, "loose")], "name string, confidence double, strategy string")
    got = violations(df, ("name",), ("confidence",), {"strategy": ("tot", "open_ie", "loose")})
    assert sorted(r["broken"] for r in got.collect()) == [["confidence"], ["name"], ["strategy"]]
