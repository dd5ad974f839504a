"""The whole path behind one object: documents to facts to an index, and questions to reports.

``Engine`` reads its knobs from ``EngineSettings`` and lets every part that has a choice be replaced: the client that answers
prompts, the detector of communities, the embedder, the summariser, the reranker and the query expander.  Each step is a
table, kept in ``tables`` under its name, so any of them can be looked at, saved or put in by hand.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import lead_summary
from factloom.functions.vectors import Embedder, hashed
from factloom.operators import communities, extraction, graph, ontology, retrieval, verification
from factloom.plans.scratch import materialise
from factloom.schemas import PROPOSALS
from factloom.sources import chat_models
from factloom.sources.documents import EngineSettings

log = logging.getLogger(__name__)


@dataclass
class Engine:
    spark: SparkSession
    settings: EngineSettings = field(default_factory=EngineSettings)
    detector: communities.Detector = communities.greedy
    embedder: Embedder | None = None
    summariser: communities.Summariser = lead_summary
    reranker: retrieval.Reranker | None = None
    expander: retrieval.Expander | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    index: retrieval.SearchIndex | None = None

    # From documents to facts

    def induce(self, documents: DataFrame, proposer: Callable[[str], dict] = ontology.capitalised_proposer, base: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """(classes, relations) from documents (doc_id, text); what ``base`` has stays as it is."""
        s = self.settings
        chunks = ontology.chunks(documents, s.chunk_size, s.chunk_overlap)
        schema = PROPOSALS.split("reply ")[1].lower().replace(": ", ":")
        proposals = materialise(ontology.propose(chunks, proposer, schema), "proposals")
        classes, relations = ontology.induce(proposals.filter("reply IS NOT NULL"), s.min_class_support, s.min_relation_support)
        if base:
            classes, relations = ontology.extended(base[0], classes, "class_id"), ontology.extended(base[1], relations, "relation_id")
        self.tables |= {"proposals": proposals, "classes": classes, "relations": relations}
        return classes, relations

    def extract(self, documents: DataFrame, classes: DataFrame, relations: DataFrame, client: Callable[[str, float], str]) -> tuple[DataFrame, DataFrame]:
        """(entities, triples) of all strategies side by side; a prompt that fails leaves a row in ``tables["failed"]``."""
        brief = ontology.schema_brief(classes, relations).first()["brief"]  # one row
        asked = extraction.ask(extraction.strategy_prompts(documents, brief, self.settings.strategies), client)
        replies = materialise(chat_models.parsed(asked, reply_fields(), "raw"), "replies")
        outputs = replies.filter("parsed IS NOT NULL").select("doc_id", "strategy", F.col("parsed").alias("reply"))
        entities = extraction.extracted_entities(outputs, ontology.name_index(with_order(classes, "class_id"), "class_id"))
        triples = extraction.extracted_triples(outputs, ontology.name_index(with_order(relations, "relation_id"), "relation_id"))
        found = [rows.withColumn("source_doc_ids", F.array("doc_id")).withColumn("ord", F.xxhash64("doc_id", "strategy", "pos")) for rows in (entities, triples)]
        entities = materialise(extraction.merged_entities(found[0]), "entities")
        triples = materialise(found[1].withColumn("is_verified", F.lit(False)), "triples")
        self.tables |= {"entities": entities, "pool": triples, "failed": replies.filter("parsed IS NULL").select("doc_id", "strategy", F.coalesce("error", "parse_error").alias("error"))}
        return entities, triples

    def extract_one(self, doc_id: str, text: str, classes: DataFrame, relations: DataFrame, client: Callable[[str, float], str]) -> tuple[DataFrame, DataFrame]:
        return self.extract(self.spark.createDataFrame([(doc_id, text)], "doc_id string, text string"), classes, relations, client)

    def verify(self, triples: DataFrame, documents: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted triples, the entities they use)."""
        s = self.settings
        limits = verification.Thresholds(strategies=s.consensus_strategies, anchor=s.anchor_threshold, evidence=s.evidence_threshold, grounding=s.grounding_threshold)
        index = entities.select(F.lit("").alias("doc_id"), F.xxhash64("entity_id").alias("ord"), F.col("entity_id").alias("id"), "name")
        decisions = materialise(verification.verify(triples, documents, index, relations, limits), "decisions")
        kept, used = verification.verified_snapshot(triples, decisions, entities)
        self.tables |= {"decisions": decisions, "triples": materialise(kept, "verified"), "verified_entities": materialise(used, "used")}
        return self.tables["triples"], self.tables["verified_entities"]

    def verify_to_graph(self, triples: DataFrame, documents: DataFrame, entities: DataFrame, classes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the property graph over the facts that a pool's verification leaves."""
        kept, used = self.verify(triples, documents, entities, relations)
        return graph.property_graph(classes, relations, used, kept)

    # From facts to an index

    def build(self, entities: DataFrame, triples: DataFrame, stored: bool = True) -> retrieval.SearchIndex:
        """Hierarchy, summaries, vectors and the index over verified facts."""
        s = self.settings
        shape = communities.HierarchySettings(s.hierarchy_levels, s.min_community_size, s.parent_blend, s.embedding_dim)
        edges = graph.entity_graph(triples, entities)
        tree = communities.hierarchy(edges, entities.select(F.col("entity_id").alias("node")), shape, self.detector)
        noted = communities.annotated(tree, entities, triples, shape, self.summariser, self.embedder)
        search = retrieval.SearchSettings(k=s.beam_width, dim=s.embedding_dim)
        self.index = retrieval.build_index(noted, entities, triples, search, self.embedder or hashed(s.embedding_dim), stored)
        self.tables["communities"] = noted
        log.info("index built")
        return self.index

    def run(self, documents: DataFrame, client: Callable[[str, float], str], proposer: Callable[[str], dict] = ontology.capitalised_proposer) -> retrieval.SearchIndex:
        """All of it: schema, candidates, verification, index."""
        classes, relations = self.induce(documents, proposer)
        entities, pool = self.extract(documents, classes, relations, client)
        triples, used = self.verify(pool, documents, entities, relations)
        return self.build(used, triples)

    # Questions

    def search(self, queries: DataFrame) -> dict[str, DataFrame]:
        """Hits of all ``queries`` (query_id, raw_query)."""
        if self.index is None:
            raise ValueError("build the index first")
        return retrieval.search(self.index, queries, self.reranker, self.expander)

    def report(self, queries: DataFrame) -> DataFrame:
        return retrieval.reports(self.index, queries, self.search(queries))

    def ask(self, question: str) -> str:
        """The report of one question."""
        return self.report(self.spark.createDataFrame([(0, question)], "query_id long, raw_query string")).first()["report"]


def with_order(rows: DataFrame, id_column: str) -> DataFrame:
    """``rows`` with ``ord``, if they have none: the order of a hash of the id."""
    return rows if "ord" in rows.columns else rows.withColumn("ord", F.xxhash64(id_column))


def reply_fields() -> str:
    """The fields of a strategy's reply as a schema."""
    return (
        "entities ARRAY<STRUCT<name: STRING, type_name: STRING, description: STRING, aliases: ARRAY<STRING>>>, "
        "triples ARRAY<STRUCT<head: STRING, relation: STRING, tail: STRING, evidence: STRING, confidence: DOUBLE>>, notes STRING"
    )
