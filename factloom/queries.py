"""The library's operators as queries over the driver's tables; whole tables, whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import ids, text, vectors
from factloom.operators import alignment, communities, extraction, graph, measures, ontology, retrieval, verification
from factloom.plans import abox
from factloom.plans.abox import table
from factloom.plans.scratch import materialise, shared_dir
from factloom.plans.sizing import dealt, once
from factloom.schemas import STRATEGIES, violations
from factloom.sources import chat_models, documents, snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, a, b: each turn's text and the next one's."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"))
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])


@query
def multiset_jaccard(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir)
    by_rows = alignment.multiset_jaccard_of(pairs, ["conv_id", "turn"], "a", "b").withColumnRenamed("jaccard", "by_rows")
    return pairs.withColumn("by_column", text.multiset_jaccard("a", "b")).join(by_rows, ["conv_id", "turn"]).select("conv_id", "turn", F.round("by_column", 6).alias("by_column"), F.round("by_rows", 6).alias("by_rows"))


@query
def lexical_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.lexical_overlap("text", "reply"), 6).alias("overlap"))


@query
def char_jaccard(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("conv_id", "turn", F.round(text.char_jaccard("a", "b"), 6).alias("chars"), F.round(text.span_conciseness("a", "b"), 6).alias("conciseness"))


@query
def edit_ratio(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(text.edit_ratio("p_name", "p_type"), 6).alias("ratio"), F.round(text.name_match("p_type", "p_name"), 6).alias("matched"))


@query
def best_window(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", F.lit("one"), F.lower("p_type"), F.lower("p_brand"), F.lit("a wodget, ringlet or balt")).alias("hay"))
    added = {"ratio": F.round(text.best_window_ratio("p_name", "hay"), 6), "surface": F.round(text.surface_similarity(F.upper("p_name"), F.upper("hay")), 6)}
    return once(p, ["p_name", "hay"], added, 1_000).select("p_partkey", "ratio", "surface")


@query
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ids.stable_id("cls", "c_name").alias("class_id"), ids.stable_id("ent", F.concat("c_name", F.lit(" é"))).alias("entity_id"))


@query
def community_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_name").alias("m"))
    return rows.select("c_nationkey", ids.community_id(F.lit(0), "c_nationkey", "m").alias("community_id"))


@query
def squeezed_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("raw", F.concat(F.lit(" \t"), "p_name", F.lit("\n  "), "p_brand", F.lit(" ")))
    return p.select("p_partkey", text.squeezed("raw").alias("name"), text.looks_like_predicate(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("predicate"))


@query
def lead_summaries(spark, sf_dir):
    """Customers by segment and nation: names up to the limit, then what fits of the evidence."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    return rows.select("c_nationkey", "c_mktsegment", text.lead_summary("names", F.array(F.lit(" "), F.concat(F.lit("In nation "), F.col("c_nationkey").cast("string"), F.lit(".")))).alias("summary"))


# Vectors


@query
def hash_embedding(spark, sf_dir):
    return vectors.hashed_buckets(dealt(table(spark, sf_dir, "part"), ["p_partkey"], 50_000), ["p_partkey"], "p_name", 64)


@query
def vector_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_top_k(e, asked, 5).select("query_id", F.col("item_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def vector_blend(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("p"))
    mixed = vectors.normalised(vectors.lerp("p", "v", 0.4))
    return e.join(nxt, "vec_id").withColumn("b", mixed).select("vec_id", F.round(vectors.dot("b", "v"), 5).alias("with_own"), F.round(vectors.norm("b"), 5).alias("length"))


@query
def similar_vectors(spark, sf_dir):
    """All vectors, and a copy of each that leans towards the next one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    copies = e.join(after, "vec_id").select((-F.col("vec_id") - 1).alias("vec_id"), F.zip_with("embedding", "b", lambda x, y: 0.9 * x + 0.3 * y).alias("embedding"))
    found = alignment.similar_vectors(e.unionByName(copies), "vec_id", "embedding")
    return found.select("a", "b", F.round("cosine", 6).alias("cosine"))


# Schema induction


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document proposes its source (a kind of its language) and its language, and a relation between them."""
    d = table(spark, sf_dir, "documents")
    source, lang = F.concat(F.lit("Source "), "source"), F.concat(F.lit(" Lang  "), "lang")
    spaced = F.when(F.col("doc_id") % 2 == 0, F.upper(source)).otherwise(source)
    none = F.array().cast("array<string>")
    about = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("from "), F.col("source"))).otherwise("")
    types = F.array(
        F.struct(spaced.alias("name"), about.alias("description"), F.array(lang).alias("parent_names"), F.array(F.col("source")).alias("aliases")),
        F.struct(lang.alias("name"), F.lit("").alias("description"), none.alias("parent_names"), none.alias("aliases")),
    )
    relation = F.struct(F.concat(F.lit("writtenIn"), "lang").alias("name"), F.lit("").alias("description"), source.alias("domain"), F.when(F.col("doc_id") % 4 > 0, lang).alias("range"),
                        F.when(F.col("doc_id") % 97 == 5, "undirected").otherwise("directed").alias("direction"), (F.col("doc_id") % 301 == 7).alias("symmetric"), F.lit(False).alias("transitive"))
    reply = F.struct(types.alias("entity_types"), F.array(relation).alias("relations"), F.lit("").alias("notes"))
    return d.select(F.col("doc_id"), F.lit(0).alias("chunk_index"), reply.alias("reply"))


@query
def chunks(spark, sf_dir):
    c = ontology.chunks(table(spark, sf_dir, "documents"), 200, 20)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"))


@query
def class_support(spark, sf_dir):
    rows = ontology.class_support(_proposals(spark, sf_dir), min_support=5)
    return rows.select("key", "name", "description", F.array_join("parents", "|").alias("parents"), F.array_join("aliases", "|").alias("aliases"), "support")


@query
def relation_support(spark, sf_dir):
    rows = ontology.relation_support(_proposals(spark, sf_dir), min_support=5)
    return rows.select("name", F.lower(text.squeezed("domain")).alias("domain"), F.lower(text.squeezed("range")).alias("range"), "direction", "symmetric", "transitive", "support")


@query
def induced_schema(spark, sf_dir):
    classes, relations = ontology.induce(_proposals(spark, sf_dir), 5, 5)
    a = classes.select(F.col("class_id").alias("id"), "name", F.array_join("parent_ids", "|").alias("refs"))
    return a.unionByName(relations.select(F.col("relation_id").alias("id"), "name", F.concat_ws("|", "domain", "range").alias("refs")))


@query
def extended_schema(spark, sf_dir):
    p = _proposals(spark, sf_dir)
    base, more = (ontology.class_support(x).select("key", "support") for x in (p.filter("doc_id % 2 = 0"), p))
    return ontology.extended(base, more, "key")


@query
def class_ancestry(spark, sf_dir):
    return ontology.ancestry(abox.classes(spark))


@query
def name_lookup(spark, sf_dir):
    e = abox.entities(spark, sf_dir).withColumn("aliases", F.array(F.replace(F.col("name"), F.lit("#"), F.lit(" ")), F.lit(" ")))
    first = ontology.name_index(e, "entity_id").withColumnRenamed("id", "first_id")
    return first.join(ontology.name_index(e, "entity_id", last=True).withColumnRenamed("id", "last_id"), "key")


# Extraction


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three strategies reply on each customer's nation: known, unknown and blank relations and ends."""
    f = abox.facts(spark, sf_dir)
    strategy = F.explode(F.array(F.lit("tot"), F.lit("open_ie"))).alias("strategy")
    e = F.array(
        F.struct(F.concat(F.lit(" "), "head_name").alias("name"), F.lit("Party ").alias("type_name"), F.lit("d").alias("description"), F.array("relation_name").alias("aliases")),
        F.struct(F.lower("head_name").alias("name"), F.lit("").alias("type_name"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases")),
    )
    t = lambda h, r, x: F.struct(h.alias("head"), r.alias("relation"), x.alias("tail"), abox.statement().alias("evidence"), F.lit(0.9).alias("confidence"))
    facts = F.array(t(F.col("head_name"), F.upper("relation_name"), F.col("tail_name")), t(F.col("head_name"), F.lit("dreamsOf"), F.col("tail_name")), t(F.lit(" "), F.col("relation_name"), F.col("tail_name")))
    return f.select(F.col("head_id").alias("doc_id"), strategy, F.struct(e.alias("entities"), facts.alias("triples"), F.lit("").alias("notes")).alias("reply"))


@query
def extracted_triples(spark, sf_dir):
    index = ontology.name_index(abox.relations(spark), "relation_id")
    return extraction.extracted_triples(_outputs(spark, sf_dir), index).select("doc_id", "strategy", "head_id", "relation_id", "tail_id", "evidence")


@query
def extracted_entities(spark, sf_dir):
    index = ontology.name_index(abox.classes(spark), "class_id")
    return extraction.extracted_entities(_outputs(spark, sf_dir), index).select("doc_id", "strategy", "entity_id", "name", "type_id", "confidence")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rows by order: each order mentions its customer, in one of two spellings."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.upper("c_name")).otherwise(F.concat(F.lit(" "), "c_name"))
    return o.select(F.concat(F.lit("m_"), F.col("o_orderkey").cast("string")).alias("entity_id"), name.alias("name"), F.col("c_mktsegment").alias("type_id"), F.lit("").alias("description"),
                    F.array("o_orderpriority").alias("aliases"), F.array(F.col("o_orderstatus")).alias("source_doc_ids"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), F.col("o_orderkey").alias("ord"))


@query
def merged_entities(spark, sf_dir):
    rows = extraction.merged_entities(_mentions(spark, sf_dir))
    return rows.select("entity_id", text.stripped("name").alias("name"), "type_id", F.array_join("aliases", "|").alias("aliases"), F.array_join("source_doc_ids", "|").alias("sources"), F.round("confidence", 6).alias("confidence"))


@query
def merged_triples(spark, sf_dir):
    rows = extraction.merged_triples(abox.triples(spark, sf_dir, supplies=True))
    return rows.select("triple_id", "head_id", "relation_id", "tail_id", "strategy", "evidence", F.round("confidence", 6).alias("confidence"))


@query
def canonicalised(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    mapping = extraction.canonical_map(m)
    t = m.select(F.concat(F.lit("t_"), "entity_id").alias("triple_id"), F.col("entity_id").alias("head_id"), F.lit("nowhere").alias("tail_id"))
    return extraction.canonicalised(t, mapping)


@query
def unioned_strategies(spark, sf_dir):
    return abox.triples(spark, sf_dir, supplies=True).groupBy("strategy").agg(F.count("*").alias("n"), F.sum(F.when(F.col("evidence") == "", 1).otherwise(0)).alias("blank"))


@query
def parsed_replies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 7 == 1, "no json").when(F.col("event_id") % 7 == 2, '{"k": 1, "z": 2}').otherwise(F.col("props"))
    rows = chat_models.parsed(e.select("event_id", reply.alias("reply")), "k int")
    return rows.select("event_id", F.coalesce(F.col("parsed.k"), F.lit(-1)).cast("long").alias("k"), F.col("parse_error").isNotNull().alias("failed"))


# Verification


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = abox.triples(spark, sf_dir)
    names = verification.entity_names(abox.entity_index(spark, sf_dir), pool)
    return verification.named_triples(pool, names, abox.relations(spark), abox.source_documents(spark, sf_dir))


@query
def consensus(spark, sf_dir):
    rows = verification.consensus(abox.triples(spark, sf_dir, supplies=True))
    return rows.select("head_id", "relation_id", "tail_id", F.array_join("strategies", ",").alias("strategies"), F.col("n_strategies").cast("long").alias("n_strategies"))


@query
def source_resolution(spark, sf_dir):
    return verification.source_texts(abox.triples(spark, sf_dir), abox.source_documents(spark, sf_dir))


@query
def evidence_scores(spark, sf_dir):
    c = [F.col(x) for x in ("head_name", "relation_name", "tail_name", "evidence", "source")]
    rows = _named(spark, sf_dir).withColumn("s", verification.evidence_score(*c))
    return rows.select("triple_id", *(F.round(f"s.{x}", 6).alias(x) for x in verification.EB))


@query
def grounding_scores(spark, sf_dir):
    c = [F.col(x) for x in ("head_name", "relation_name", "tail_name", "source")]
    rows = _named(spark, sf_dir).withColumn("s", verification.grounding_score(*c))
    return rows.select("triple_id", *(F.round(f"s.{x}", 6).alias(x) for x in verification.EC))


@query
def cascade(spark, sf_dir):
    rows = verification.decide(_named(spark, sf_dir))
    return rows.select("triple_id", "accepted", "filter_tag", F.round("tier_score", 6).alias("tier_score"), "rejected_reason")


@query
def decision_counts(spark, sf_dir):
    return verification.decision_counts(verification.decide(_named(spark, sf_dir)))


@query
def verified_snapshot(spark, sf_dir):
    pool = abox.triples(spark, sf_dir)
    kept, used = verification.verified_snapshot(pool, verification.decide(_named(spark, sf_dir)), abox.entities(spark, sf_dir))
    return kept.select(F.lit("triple").alias("kind"), F.col("triple_id").alias("id")).unionByName(used.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")))


@query
def deduplicated_facts(spark, sf_dir):
    pool = abox.triples(spark, sf_dir, supplies=True)
    first = verification.deduplicated_facts(pool).select("head_id", "relation_id", "tail_id", F.col("triple_id").alias("first_id"))
    return first.join(verification.deduplicated_facts(pool, "richest").select("head_id", "relation_id", "tail_id", F.col("triple_id").alias("richest_id")), ["head_id", "relation_id", "tail_id"])


@query
def checked_facts(spark, sf_dir):
    pool = verification.syntactic_check(abox.triples(spark, sf_dir, supplies=True))
    wrong = pool.withColumn("relation_id", F.when(F.col("ord") % 11 == 0, "rel_in").otherwise(F.col("relation_id")))
    return verification.semantic_check(wrong, abox.entities(spark, sf_dir), abox.relations(spark), ontology.ancestry(abox.classes(spark))).select("triple_id", "relation_id")


# Graphs and communities


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of all facts, parts with their suppliers too."""
    return graph.entity_graph(abox.verified(spark, sf_dir, True), abox.entities(spark, sf_dir))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, community: everything in a nation's region, parts by size."""
    f = abox.facts(spark, sf_dir)
    nation = f.filter("relation_id = 'rel_in'").select(F.col("head_id").alias("nation"), F.col("tail_id").alias("community"))
    based = f.filter("relation_id = 'rel_based'").join(nation, F.col("tail_id") == F.col("nation")).select(F.col("head_id").alias("node"), "community")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("par_"), F.col("p_partkey").cast("string")).alias("node"), F.concat(F.lit("size_"), (F.col("p_size") % 5).cast("string")).alias("community"))
    return nation.select(F.col("nation").alias("node"), "community").unionByName(nation.select(F.col("community").alias("node"), "community").distinct()).unionByName(based).unionByName(parts)


@query
def entity_graph(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def contracted_graph(spark, sf_dir):
    return graph.contracted(_edges(spark, sf_dir), _regions(spark, sf_dir))


@query
def modularity(spark, sf_dir):
    return graph.modularity(_edges(spark, sf_dir), _regions(spark, sf_dir)).select(F.round("modularity", 6).alias("modularity"))


@query
def node_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query
def connected_components(spark, sf_dir):
    return graph.connected(_edges(spark, sf_dir))


@query
def nodes_within_two_hops(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("reg_"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.neighbours_within(_edges(spark, sf_dir), starts, 2).select("start", "node", F.col("distance").cast("long").alias("distance"))


@query
def incident_triples(spark, sf_dir):
    few = abox.entities(spark, sf_dir).filter("type_id = 'cls_nation'")
    return graph.triples_of(abox.verified(spark, sf_dir, True), few).select("triple_id")


@query
def property_graph(spark, sf_dir):
    e = abox.entities(spark, sf_dir).withColumn("description", F.lit("")).withColumn("confidence", F.lit(1.0))
    t = abox.verified(spark, sf_dir, True).withColumn("strategy", F.lit("tot")).withColumn("confidence", F.lit(1.0))
    nodes, edges = graph.property_graph(abox.classes(spark), abox.relations(spark), e, t)
    return nodes.select("kind", "id", F.col("label").alias("other")).unionByName(edges.select("kind", F.col("src").alias("id"), F.col("dst").alias("other")))


def _given_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations over what is based there, as communities with hand-made ids."""
    f = abox.facts(spark, sf_dir).select("head_id", "relation_id", "tail_id")
    none = F.array().cast("array<string>")
    based = f.filter("relation_id = 'rel_based'").groupBy(F.col("tail_id").alias("community_id")).agg(F.array_sort(F.collect_list("head_id")).alias("entity_ids"))
    nation = based.join(f.filter("relation_id = 'rel_in'").select(F.col("head_id").alias("community_id"), F.col("tail_id").alias("parent_id")), "community_id")
    nation = nation.select("community_id", F.lit(0).alias("level"), F.substring("community_id", 5, 9).cast("int").alias("ord"), "entity_ids", "parent_id", none.alias("child_ids"))
    region = nation.groupBy(F.col("parent_id").alias("community_id")).agg(F.array_sort(F.flatten(F.collect_list("entity_ids"))).alias("entity_ids"), F.array_sort(F.collect_list("community_id")).alias("child_ids"))
    region = region.select("community_id", F.lit(1).alias("level"), F.substring("community_id", 5, 9).cast("int").alias("ord"), "entity_ids", F.lit(None).cast("string").alias("parent_id"), "child_ids")
    return nation.unionByName(region)


@query
def community_summaries(spark, sf_dir):
    return communities.summaries(_given_hierarchy(spark, sf_dir), abox.entities(spark, sf_dir), abox.verified(spark, sf_dir, True))


@query
def hierarchy_walk(spark, sf_dir):
    return communities.walk(_given_hierarchy(spark, sf_dir), 2).select("community_id", F.col("level").cast("long").alias("level"), F.array_join("path", "/").alias("path"), F.col("depth").cast("long").alias("depth"))


@query
def community_members(spark, sf_dir):
    return communities.entities_in(_given_hierarchy(spark, sf_dir), abox.entities(spark, sf_dir)).select("community_id", "entity_id", "name")


@query
def greedy_communities(spark, sf_dir):
    e = abox.entities(spark, sf_dir).select(F.col("entity_id").alias("node"))
    found = communities.detect(_edges(spark, sf_dir), e, 0)
    return found.select("community_id", "ord", F.size("members").alias("size"))


@query
def louvain_communities(spark, sf_dir):
    e = abox.entities(spark, sf_dir).select(F.col("entity_id").alias("node"))
    found = communities.detect(_edges(spark, sf_dir), e, 0, detector=communities.louvain)
    return found.select("community_id", "ord", F.size("members").alias("size"))


@query
def community_hierarchy(spark, sf_dir):
    e = abox.entities(spark, sf_dir).select(F.col("entity_id").alias("node"))
    found = communities.hierarchy(_edges(spark, sf_dir), e)
    return found.select("community_id", "level", "ord", F.size("entity_ids").alias("size"), "parent_id")


# Retrieval


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("who is based in "), "n_name").alias("raw_query"))


def _index(spark: SparkSession, sf_dir: str) -> retrieval.SearchIndex:
    e, t = abox.entities(spark, sf_dir), abox.verified(spark, sf_dir, True)
    return retrieval.build_index(communities.annotated(_given_hierarchy(spark, sf_dir), e, t), e, t, stored=False)


@query
def beam_search(spark, sf_dir):
    found = retrieval.search(_index(spark, sf_dir), _questions(spark, sf_dir))
    return retrieval.hits_table(found).select("query_id", "stage", "kind", "item_id", F.round("score", 6).alias("score"), "rank", F.array_join("path", "/").alias("route"))


@query
def beam_reports(spark, sf_dir):
    index, asked = _index(spark, sf_dir), _questions(spark, sf_dir)
    return retrieval.reports(index, asked, retrieval.search(index, asked))


@query
def beam_traces(spark, sf_dir):
    rows = retrieval.beam_trace(retrieval.search(_index(spark, sf_dir), _questions(spark, sf_dir)))
    return rows.select("query_id", "stage", "kind", F.array_join("kept", "|").alias("kept"), F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x), 6).alias("score_sum"))


@query
def lexical_top_k(spark, sf_dir):
    """Stage-like ranking with a given prior: the three best parts for each brand's wish, ties by key."""
    wish = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(F.concat_ws(" ", "p_type", "p_name")).alias("wish"))
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    rows = parts.join(wish, "p_brand").select(F.col("p_brand").alias("query_id"), "p_partkey", vectors.blended(text.lexical_overlap("wish", "t"), F.lit(0.5), 0.5).alias("score"))
    return retrieval.top_k(rows, 3, order=("p_partkey",)).select("query_id", "p_partkey", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def bm25_scores(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))
    # Copies tie; their sums differ in the last bits, so scores are rounded before they are ranked.
    scores = retrieval.bm25(table(spark, sf_dir, "documents"), items).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scores, 3, order=("doc_id",)).select("query_id", "doc_id", F.round("score", 4).alias("score"))


# Alignment and measures


@query
def overlapping_names(spark, sf_dir):
    """Part names with brand and type: pairs that overlap by 0.8 of their words, through one of each equal name."""
    p = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_type", F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))).alias("name")).agg(F.min("p_partkey").alias("id"))
    return alignment.prefix_pairs(p, "id", "name", 0.8).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query
def alias_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.array(F.upper("p_name")).alias("aliases"))
    return alignment.alias_groups(p, 0.9)


@query
def event_histogram(spark, sf_dir):
    return measures.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", (1.0, 5.0, 10.0, 50.0)).select("event_type", "count", F.round("total", 2).alias("total"), *(f"le_{i}" for i in range(4)))


@query
def near_duplicate_facts(spark, sf_dir):
    t = abox.triples(spark, sf_dir)
    return alignment.near_duplicate_triples(t).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query
def level_sizes(spark, sf_dir):
    h = materialise(_given_hierarchy(spark, sf_dir), "given")
    w = Window.partitionBy("level")
    return h.select("level", F.size("entity_ids").alias("n")).withColumn("m", F.sum("n").over(w)).groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("communities"), F.max("m").alias("members"))


# What is stored, asked and derived


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def stored_documents(spark, sf_dir):
    """Documents written as JSON lines and loaded again; blank ones are left out."""
    path = _scratch(spark, "documents")
    documents.write_json(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), path)
    return documents.load_documents(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query
def stored_graph(spark, sf_dir):
    """The property graph written as GraphML and loaded again."""
    e = abox.entities(spark, sf_dir).withColumn("description", F.lit("")).withColumn("confidence", F.lit(1.0))
    t = abox.verified(spark, sf_dir, True).withColumn("strategy", F.lit("tot")).withColumn("confidence", F.lit(1.0))
    path = _scratch(spark, "graph")
    snapshots.save_graph(*graph.property_graph(abox.classes(spark), abox.relations(spark), e, t), path, "graphml")
    nodes, edges = snapshots.load_graph(spark, path, "graphml")
    return nodes.select("kind", "id", F.col("label").alias("other")).unionByName(edges.select("kind", F.col("src").alias("id"), F.col("dst").alias("other")))


@query
def stored_snapshot(spark, sf_dir):
    """Two versions saved; the second is read."""
    path, e, t = _scratch(spark, "snapshot"), abox.entities(spark, sf_dir), abox.verified(spark, sf_dir, True)
    snapshots.save_snapshot({"entities": e.limit(1)}, path, 1)
    snapshots.save_snapshot({"entities": e, "triples": t}, path, 2)
    tables, version = snapshots.load_snapshot(spark, path)
    by_type = tables["entities"].groupBy(F.col("type_id").alias("kind")).agg(F.count("*").alias("n"))
    by_relation = tables["triples"].groupBy(F.col("relation_id").alias("kind")).agg(F.count("*").alias("n"))
    return by_type.unionByName(by_relation).withColumn("version", F.lit(version))


@query
def cached_replies(spark, sf_dir):
    """A scripted model asked about each part; equal requests are sent once, and the second time none is."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("m").alias("model"), F.concat(F.lit("kind "), "p_type", F.lit(" of size "), F.col("p_size").cast("string")).alias("prompt"), (F.col("p_size") % 2).cast("double").alias("temperature"))
    make = chat_models.scripted([("SMALL", '{"v": 1}'), ("LARGE", '```json\n{"v": 2}\n```'), ("PROMO", '{"w": 3}'), ("size 7", "no json"), ("kind", '{"v": 4}')])
    first, new = chat_models.cached_chat(p, spark.createDataFrame([], "fingerprint string, reply string"), make, "scripted")
    cache = materialise(new.select("fingerprint", "reply"), "cache")
    again, fresh = chat_models.cached_chat(p, cache, chat_models.scripted([]), "scripted")
    rows = chat_models.parsed(again, "v int").select("p_partkey", F.coalesce("parsed.v", F.lit(-1)).cast("long").alias("v"), F.col("parse_error").isNotNull().alias("failed"))
    return rows.crossJoin(F.broadcast(cache.agg(F.count("*").alias("sent")))).crossJoin(F.broadcast(fresh.agg(F.count("*").alias("sent_again"))))


@query
def typed_edges(spark, sf_dir):
    rows = abox.triples(spark, sf_dir, supplies=True).withColumn("is_verified", F.col("evidence") != "")
    return graph.typed_graph(rows, abox.entities(spark, sf_dir), 0.6).select("src", "dst", "relation_id", "weight", F.round("confidence", 6).alias("confidence"))


@query
def tier_levels(spark, sf_dir):
    pool = abox.triples(spark, sf_dir, supplies=True)
    wrong = pool.withColumn("relation_id", F.when(F.col("ord") % 11 == 0, "rel_in").otherwise(F.col("relation_id"))).withColumn("eb_total", F.col("confidence")).withColumn("ec_total", F.col("confidence") - 0.35)
    rows = verification.tier_cascade(wrong, abox.entities(spark, sf_dir), abox.relations(spark), ontology.ancestry(abox.classes(spark)))
    return rows.select("triple_id", F.array_join("tier_levels", ">").alias("levels"), "accepted", "rejected_reason")


@query
def evidential_facts(spark, sf_dir):
    pool = abox.triples(spark, sf_dir, supplies=True).withColumn("eb_total", F.col("confidence")).withColumn("ec_total", F.col("confidence") - 0.35)
    return verification.evidential_check(pool).select("triple_id", F.round("combined", 6).alias("combined"))


@query
def strategy_prompts(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extraction.strategy_prompts(items, "- Server").select("doc_id", "strategy", "temperature", F.md5("prompt").alias("prompt_md5"))


@query
def strategy_replies(spark, sf_dir):
    """Each strategy's prompt answered by a rule that fails on one source; failures stay in their row."""
    items = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" in "), "lang").alias("text"))

    def client(prompt: str, heat: float) -> str:
        last = prompt.splitlines()[-1]
        if last.startswith("src3 "):
            raise RuntimeError("busy")
        return f"{last} at {heat}"

    rows = extraction.ask(extraction.strategy_prompts(items, ""), client)
    return rows.select("doc_id", "strategy", F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce("error", F.lit("")).alias("error"))


@query
def facts_between(spark, sf_dir):
    return graph.triples_between(abox.verified(spark, sf_dir, True), "sup_1", "par_1").unionByName(graph.triples_between(abox.verified(spark, sf_dir, True), "nat_3", "reg_1")).select("triple_id")


@query
def fact_surfaces(spark, sf_dir):
    return retrieval.triple_surfaces(abox.triples(spark, sf_dir, supplies=True)).select("triple_id", "surface")


@query
def community_vectors(spark, sf_dir):
    """The cells of each community's vector that aren't zero, from the top down."""
    rows = communities.annotated(_given_hierarchy(spark, sf_dir), abox.entities(spark, sf_dir), abox.verified(spark, sf_dir, True))
    cells = rows.select("community_id", F.posexplode("centroid").alias("bucket", "weight")).withColumn("weight", F.round("weight", 6))
    return cells.filter("abs(weight) >= 0.00001")


@query
def community_roots_and_children(spark, sf_dir):
    h = materialise(_given_hierarchy(spark, sf_dir), "given")
    top = communities.roots(h)
    return top.select("community_id", F.lit("root").alias("kind")).unionByName(communities.children_of(h, top).select("community_id", F.lit("child").alias("kind")))


@query
def rule_violations(spark, sf_dir):
    """Rows that break field rules, and which."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, "event_type").alias("_t"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).otherwise(" ").alias("name"), (F.col("value") / 50).alias("confidence"), F.element_at(F.array(F.lit("tot"), F.lit("open_ie"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("strategy")).drop("_t")
    return violations(rows, ("name",), ("confidence",), {"strategy": STRATEGIES}).select("event_id", F.array_join("broken", ",").alias("broken"))


@query
def mixed_ranking(spark, sf_dir):
    """Keyword scores scaled to their query's best, mixed with a dense score of the words' overlap."""
    d = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") / 50).alias("dense"), F.col("p_retailprice"))
    dense = d.filter("p_partkey % 3 <> 0").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), F.col("dense").alias("score"))
    keyword = d.filter("p_partkey % 3 <> 1").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("score"))
    return retrieval.combined_ranking(dense, keyword).select("query_id", "doc_id", F.round("score", 6).alias("score"))
