"""The evidence cascade.

F1 accepts facts that several strategies found and whose names the source text anchors; F2 accepts
explicit evidence; F3 accepts names grounded in the source.  Scores of a later step are computed for
rows the earlier ones left open only: each step is a filter, not a column over all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import best_window_ratio, multiset_jaccard, name_match, span_conciseness, surface_similarity
from factloom.plans.scratch import materialise
from factloom.schemas import LEVELS


def _sum_to_one(weights: tuple[float, ...], what: str) -> None:
    if any(w < 0 for w in weights) or not math.isclose(sum(weights), 1.0, abs_tol=1e-6):
        raise ValueError(f"{what} weights must be non-negative and sum to 1")


@dataclass(frozen=True)
class EvidenceWeights:
    complete: float = 0.35
    subject: float = 0.25
    object: float = 0.25
    conciseness: float = 0.15

    def __post_init__(self):
        _sum_to_one((self.complete, self.subject, self.object, self.conciseness), "evidence")


@dataclass(frozen=True)
class GroundingWeights:
    subject: float = 0.45
    object: float = 0.45
    coherence: float = 0.10

    def __post_init__(self):
        _sum_to_one((self.subject, self.object, self.coherence), "grounding")


@dataclass(frozen=True)
class Thresholds:
    strategies: int = 2
    anchor: float = 0.90
    evidence: float = 0.90
    grounding: float = 0.75


def evidence_score(head: Column, relation: Column, tail: Column, evidence: Column, source: Column, w: EvidenceWeights = EvidenceWeights()) -> Column:
    """A struct of weighted parts and their total, added in this order."""
    s, o, r = name_match(head, evidence), name_match(tail, evidence), name_match(relation, evidence)
    parts = F.struct(
        (F.when((s == 1) & (o == 1) & (r == 1), F.lit(1.0)).otherwise((s + o + r) / 3) * w.complete).alias("eb_complete"),
        (s * w.subject).alias("eb_subject"), (o * w.object).alias("eb_object"), (span_conciseness(evidence, source) * w.conciseness).alias("eb_conciseness"),
    )
    return parts.withField("eb_total", parts["eb_complete"] + parts["eb_subject"] + parts["eb_object"] + parts["eb_conciseness"])


def grounding_score(head: Column, relation: Column, tail: Column, source: Column, w: GroundingWeights = GroundingWeights()) -> Column:
    none = lambda c: F.nullif(c, F.lit(""))
    parts = F.struct(
        (best_window_ratio(F.lower(head), F.lower(source)) * w.subject).alias("ec_subject"), (best_window_ratio(F.lower(tail), F.lower(source)) * w.object).alias("ec_object"),
        (multiset_jaccard(F.concat_ws(" ", none(head), none(relation), none(tail)), source) * w.coherence).alias("ec_coherence"),
    )
    return parts.withField("ec_total", parts["ec_subject"] + parts["ec_object"] + parts["ec_coherence"])


def combined_evidence(eb: str | Column, ec: str | Column) -> Column:
    """The geometric mean of both scores."""
    return F.sqrt((F.col(eb) if isinstance(eb, str) else eb) * (F.col(ec) if isinstance(ec, str) else ec))


def consensus(triples: DataFrame) -> DataFrame:
    """head_id, relation_id, tail_id, strategies (sorted), n_strategies, by hash aggregation, not by comparing pairs."""
    by = ["head_id", "relation_id", "tail_id"]
    return triples.groupBy(*by).agg(F.array_sort(F.collect_set("strategy")).alias("strategies")).withColumn("n_strategies", F.size("strategies"))


def entity_names(entity_index: DataFrame, triples: DataFrame) -> DataFrame:
    """id, name: the last entry of each id; ids as their own names if the index is empty."""
    last = entity_index.filter(F.coalesce(F.col("id"), F.lit("")) != "").groupBy("id").agg(F.max_by("name", F.struct("doc_id", "ord")).alias("name"))
    if entity_index.limit(1).count():
        return last
    ids = triples.select(F.explode(F.array("head_id", "tail_id")).alias("id")).distinct()
    return ids.withColumn("name", F.col("id"))


def source_texts(triples: DataFrame, documents: DataFrame) -> DataFrame:
    """triple_id, source: the text of the first source document that exists."""
    wanted = triples.select("triple_id", F.posexplode("source_doc_ids").alias("_pos", "doc_id"))
    found = wanted.join(documents.select("doc_id").distinct(), "doc_id").groupBy("triple_id").agg(F.min_by("doc_id", "_pos").alias("doc_id"))
    return found.join(documents.select("doc_id", F.col("text").alias("source")), "doc_id").select("triple_id", "source")


def named_triples(triples: DataFrame, names: DataFrame, relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Triples with head_name, relation_name, tail_name and source, empty where unknown; head_known and tail_known."""
    head = names.select(F.col("id").alias("head_id"), F.col("name").alias("head_name"), F.lit(True).alias("head_known"))
    tail = names.select(F.col("id").alias("tail_id"), F.col("name").alias("tail_name"), F.lit(True).alias("tail_known"))
    rows = triples.join(head, "head_id", "left").join(tail, "tail_id", "left")
    rows = rows.join(relations.select("relation_id", F.col("name").alias("relation_name")), "relation_id", "left")
    rows = rows.join(source_texts(triples, documents), "triple_id", "left")
    rows = rows.fillna("", ["head_name", "relation_name", "tail_name", "source", "evidence"])
    return rows.fillna(False, ["head_known", "tail_known"])


EB = ("eb_complete", "eb_subject", "eb_object", "eb_conciseness", "eb_total")
EC = ("ec_subject", "ec_object", "ec_coherence", "ec_total")


def decide(named: DataFrame, thresholds: Thresholds = Thresholds(), eb: EvidenceWeights = EvidenceWeights(), ec: GroundingWeights = GroundingWeights()) -> DataFrame:
    """One decision for each triple: accepted, filter_tag, strategies, the scores that were computed, tier_score, rejected_reason.

    Names are anchored once for each distinct (name, source document), by the hash of the source.
    """
    agreed = named.join(consensus(named), ["head_id", "relation_id", "tail_id"])
    agreed = agreed.withColumn("_many", F.col("n_strategies") >= thresholds.strategies)
    candidate = F.col("_many") & F.col("head_known") & F.col("tail_known")
    anchored = (surface_similarity("head_name", "source") >= thresholds.anchor) & (surface_similarity("tail_name", "source") >= thresholds.anchor)
    rows = materialise(agreed.withColumn("_f1", F.when(candidate, anchored).otherwise(F.lit(False))), "f1")
    by_consensus = rows.filter("_f1").withColumn("filter_tag", F.lit("F1_consensus"))
    open_1 = rows.filter("NOT _f1").withColumn("_eb", F.when(F.col("evidence") != "", evidence_score(*(F.col(c) for c in ("head_name", "relation_name", "tail_name", "evidence", "source")), eb)))
    open_1 = materialise(open_1.select("*", *(F.col(f"_eb.{c}") for c in EB)).drop("_eb"), "f2")
    passes = F.coalesce(F.col("eb_total") >= thresholds.evidence, F.lit(False))
    by_evidence = open_1.filter(passes).withColumn("filter_tag", F.lit("F2_explicit_evidence"))
    open_2 = open_1.filter(~passes).withColumn("_ec", grounding_score(*(F.col(c) for c in ("head_name", "relation_name", "tail_name", "source")), ec))
    open_2 = open_2.select("*", *(F.col(f"_ec.{c}") for c in EC)).drop("_ec")
    by_grounding = open_2.withColumn("filter_tag", F.when(F.col("ec_total") >= thresholds.grounding, "F3_soft_grounding").otherwise("rejected"))
    out = by_grounding.unionByName(by_evidence, allowMissingColumns=True).unionByName(by_consensus, allowMissingColumns=True)
    reason = F.coalesce(
        F.when(F.col("eb_total") < thresholds.evidence, F.format_string(f"E_B=%.3f < {thresholds.evidence:.3f}", "eb_total")),
        F.format_string(f"E_C=%.3f < {thresholds.grounding:.3f}", "ec_total"),
    )
    # F2 and F3 share a tier; after F3 its score is the mean with an evidence score that counts as 0.
    tier = F.when(F.col("filter_tag") == "F2_explicit_evidence", F.col("eb_total")).when(F.col("filter_tag") == "F3_soft_grounding", F.col("ec_total") / 2)
    return out.select(
        "triple_id", "head_id", "relation_id", "tail_id", "strategy", "head_name", "relation_name", "tail_name", (F.col("filter_tag") != "rejected").alias("accepted"), "filter_tag",
        F.when(F.col("filter_tag") == "F1_consensus", F.col("strategies")).alias("consensus_strategies"), *EB, *EC,
        F.when(F.col("filter_tag") == "F1_consensus", "semantic").when(F.col("filter_tag") != "rejected", "evidential").alias("level_reached"),
        tier.alias("tier_score"), F.when(F.col("filter_tag") == "rejected", reason).alias("rejected_reason"),
    )


def verify(triples: DataFrame, documents: DataFrame, entity_index: DataFrame, relations: DataFrame, thresholds: Thresholds = Thresholds(), **weights) -> DataFrame:
    """Names, sources and decisions for a pool of candidate triples."""
    return decide(named_triples(triples, entity_names(entity_index, triples), relations, documents), thresholds, **weights)


def verified_snapshot(triples: DataFrame, decisions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted triples, the entities they use); an unknown entity has its id as name."""
    about = decisions.filter("accepted").select("triple_id", "filter_tag", "level_reached", "tier_score", "consensus_strategies")
    kept = triples.drop("is_verified").join(about, "triple_id").withColumn("is_verified", F.lit(True))
    used = kept.select(F.explode(F.array("head_id", "tail_id")).alias("entity_id")).distinct()
    return kept, used.join(entities, "entity_id", "left").withColumn("name", F.coalesce("name", "entity_id"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("filter_tag").agg(F.count("*").alias("n"))


def deduplicated_facts(triples: DataFrame, keep: str = "first") -> DataFrame:
    """One triple for each fact: the first (by ord) or the one with the richest (longest) evidence."""
    order = {"first": [F.col("ord")], "richest": [F.length("evidence").desc_nulls_last(), F.col("ord")]}[keep]
    w = Window.partitionBy("head_id", "relation_id", "tail_id").orderBy(*order)
    return triples.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _syntactic(min_evidence: int = 5) -> Column:
    return (F.length("evidence") >= min_evidence) & (F.col("head_id") != F.col("tail_id"))


def syntactic_check(triples: DataFrame, min_evidence: int = 5) -> DataFrame:
    """Facts with enough evidence text that don't point at themselves."""
    return triples.filter(_syntactic(min_evidence))


def _with_types(triples: DataFrame, entities: DataFrame, relations: DataFrame, ancestry: DataFrame) -> tuple[DataFrame, Column]:
    """``triples`` with their rules and both ends' types, a row each, and whether an end's types are what a rule allows."""
    rules = relations.groupBy("relation_id").agg(F.collect_set(F.struct("domain", "range")).alias("_rules"))
    rows = triples.join(rules, "relation_id", "left")
    types = entities.filter(F.col("type_id").isNotNull()).select("entity_id", "type_id").join(ancestry.withColumnRenamed("class_id", "type_id"), "type_id").groupBy("entity_id").agg(F.collect_set("ancestor_id").alias("_t"))
    for side in ("head", "tail"):
        rows = rows.join(types.select(F.col("entity_id").alias(f"{side}_id"), F.col("_t").alias(f"_{side}")), f"{side}_id", "left")
    fits = lambda side, need: F.col(f"_{side}").isNotNull() & (need.isNull() | F.array_contains(f"_{side}", need))
    return rows, F.coalesce(F.exists("_rules", lambda r: fits("head", r["domain"]) & fits("tail", r["range"])), F.lit(False))


def semantic_check(triples: DataFrame, entities: DataFrame, relations: DataFrame, ancestry: DataFrame) -> DataFrame:
    """Facts whose endpoints have types that the relation's domain and range (or null) allow, ancestors included.

    ``ancestry`` has (class_id, ancestor_id), each class being its own ancestor.
    """
    rows, allowed = _with_types(triples, entities, relations, ancestry)
    return rows.filter(allowed).select(*triples.columns)


def _evidential(eb: float = 0.55, ec: float = 0.30, combined: float = 0.45, spans: int = 5) -> Column:
    return (F.col("eb_total") >= eb) & (F.col("ec_total") >= ec) & (combined_evidence("eb_total", "ec_total") >= combined)


def evidential_check(scored: DataFrame, eb: float = 0.55, ec: float = 0.30, combined: float = 0.45, spans: int = 5) -> DataFrame:
    """Scored facts above three floors, with at most ``spans`` supporting spans each."""
    rows = scored.filter(_evidential(eb, ec, combined)).withColumn("combined", combined_evidence("eb_total", "ec_total"))
    return rows.withColumn("supporting_spans", F.slice("supporting_spans", 1, spans)) if "supporting_spans" in scored.columns else rows


def tier_cascade(scored: DataFrame, entities: DataFrame, relations: DataFrame, ancestry: DataFrame, levels: tuple[str, ...] = LEVELS, **floors) -> DataFrame:
    """``scored`` with tier_levels (those passed, in order), accepted, level_reached and rejected_reason (the level that failed).

    A level counts if all before it passed.  Levels are conditions on one pass over the rows, which are joined to their ends' types once.
    """
    unknown = set(levels) - {"syntactic", "semantic", "evidential"}
    if unknown:
        raise ValueError(f"unknown levels: {sorted(unknown)}")
    rows, allowed = _with_types(scored, entities, relations, ancestry) if "semantic" in levels else (scored, F.lit(True))
    so_far, passed = F.lit(True), []
    for level in levels:
        so_far = so_far & F.coalesce({"syntactic": _syntactic(), "semantic": allowed, "evidential": _evidential(**floors) if level == "evidential" else None}[level], F.lit(False))
        passed.append(F.when(so_far, level))
    out = rows.select(*(F.col(f"`{c}`") for c in scored.columns), F.array_compact(F.array(*passed)).cast("array<string>").alias("tier_levels"))
    n = F.size("tier_levels")
    failed = F.get(F.array(*map(F.lit, levels)), n)
    return out.withColumn("accepted", n == len(levels)).withColumn("level_reached", F.get("tier_levels", n - 1)).withColumn("rejected_reason", failed)
