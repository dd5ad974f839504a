"""Candidate facts from the replies of several strategies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.ids import stable_id
from factloom.functions.text import stripped
from factloom.schemas import STRATEGIES

MAX_ENTITIES, MAX_TRIPLES = 50, 80
TYPED, UNTYPED = 0.8, 0.5
TEMPERATURES = {"tot": 0.0, "open_ie": 0.0, "loose": 0.4}
ASKS = {
    "tot": "Think through the schema class by class, then list every fact that it allows.",
    "open_ie": "List every fact that the text states, in its own order.",
    "loose": "List facts that the text states or plainly implies.",
}
RULES = "Answer with JSON that has the keys entities, triples and notes. Quote the words that show each fact as its evidence."


def strategy_prompts(documents: DataFrame, brief: str, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """doc_id, strategy, temperature, prompt: a row per document that isn't blank and strategy."""
    if not strategies:
        raise ValueError("at least one strategy")
    asks = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(TEMPERATURES.get(s, 0.0)).alias("temperature"), F.lit(ASKS.get(s, "")).alias("ask")) for s in strategies)))
    rows = documents.filter(stripped("text") != "").select("doc_id", "text", asks.alias("_s")).select("doc_id", "text", "_s.*")
    return rows.select("doc_id", "strategy", "temperature", F.concat_ws("\n", "ask", F.lit(RULES), F.lit(brief), F.lit(""), "text").alias("prompt"))


def ask(prompts: DataFrame, client: Callable[[str, float], str]) -> DataFrame:
    """Adds raw and error: one call per prompt, in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, error = [], []
            for prompt, heat in zip(b["prompt"], b["temperature"], strict=True):
                try:
                    raw.append(client(prompt, heat))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  any client error belongs to its row
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield b.assign(raw=raw, error=error)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, fields + ", raw string, error string")


def strategy_tags(outputs: DataFrame) -> DataFrame:
    return outputs.select("strategy").distinct()


def _rows(outputs: DataFrame, field: str, most: int, alias: str) -> DataFrame:
    return outputs.select("doc_id", "strategy", F.posexplode(F.slice(f"reply.{field}", 1, most)).alias("pos", alias))


def extracted_entities(outputs: DataFrame, class_index: DataFrame, compat: bool = False) -> DataFrame:
    """entity_id, doc_id, strategy, name, type_id, description, aliases, confidence, pos.

    Names are compared in lower case and the first mention holds.  Facts' ends that no entity row names
    are entities too, without a type; ``compat`` leaves those out.
    """
    named = _rows(outputs, "entities", MAX_ENTITIES, "e").select("doc_id", "strategy", "pos", stripped("e.name").alias("name"), F.lower(stripped("e.type_name")).alias("key"), "e.description", "e.aliases")
    if not compat:
        ends = _rows(outputs, "triples", MAX_TRIPLES, "t").select("doc_id", "strategy", (F.lit(MAX_ENTITIES) + F.col("pos")).alias("pos"), F.explode(F.array("t.head", "t.tail")).alias("name"))
        named = named.unionByName(ends.withColumn("name", stripped("name")), allowMissingColumns=True)
    w = Window.partitionBy("doc_id", "strategy", F.lower("name")).orderBy("pos")
    rows = named.filter(F.coalesce("name", F.lit("")) != "").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    rows = rows.join(class_index.select("key", F.col("id").alias("type_id")), "key", "left")
    return rows.select(
        stable_id("ent", "name").alias("entity_id"), "doc_id", "strategy", "name", "type_id", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.when(F.col("type_id").isNull(), UNTYPED).otherwise(TYPED).alias("confidence"), "pos",
    )


def extracted_triples(outputs: DataFrame, relation_index: DataFrame) -> DataFrame:
    """triple_id, head_id, relation_id, tail_id, evidence, doc_id, strategy, confidence, pos; unknown relations and blank ends are dropped."""
    rows = _rows(outputs, "triples", MAX_TRIPLES, "t").select("doc_id", "strategy", "pos", "t.*")
    rows = rows.filter((F.coalesce(stripped("head"), F.lit("")) != "") & (F.coalesce(stripped("tail"), F.lit("")) != "")).withColumn("key", F.lower(stripped("relation")))
    rows = rows.join(relation_index.select("key", F.col("id").alias("relation_id")), "key")
    rows = rows.withColumn("head_id", stable_id("ent", stripped("head"))).withColumn("tail_id", stable_id("ent", stripped("tail")))
    number = F.concat_ws(":", "doc_id", "strategy", "pos", "head_id", "relation_id", "tail_id")
    return rows.select(
        F.concat(F.lit("tr_"), F.substring(F.sha1(number), 1, 12)).alias("triple_id"), "head_id", "relation_id", "tail_id", F.coalesce("evidence", F.lit("")).alias("evidence"),
        "doc_id", "strategy", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "pos",
    )


def _ordered_union(column: str, order: str):
    """Distinct values of arrays, in order of first appearance."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(order, column)))
    return F.array_distinct(F.flatten(F.transform(sorted_rows, lambda x: x[column])))


def merged_entities(entities: DataFrame) -> DataFrame:
    """Entities of one lower-cased name as one: the first row's fields, sources and aliases united in order, the highest confidence."""
    rows = entities.withColumn("_key", F.lower(stripped("name")))
    first = [F.min_by(c, "ord").alias(c) for c in ("entity_id", "name", "type_id", "description")]
    return rows.groupBy("_key").agg(*first, _ordered_union("aliases", "ord").alias("aliases"), _ordered_union("source_doc_ids", "ord").alias("source_doc_ids"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord")).drop("_key")


def merged_triples(triples: DataFrame) -> DataFrame:
    """Triples of one fact as one: the first row's fields, the longest evidence (ties: the earlier), the highest confidence.

    Not for the consensus step: merging forgets which strategies agreed.
    """
    first = [F.min_by(c, "ord").alias(c) for c in ("triple_id", "strategy")]
    longest = F.max_by("evidence", F.struct(F.length("evidence").alias("n"), (-F.col("ord")).alias("o"))).alias("evidence")
    return triples.groupBy("head_id", "relation_id", "tail_id").agg(*first, longest, F.max("confidence").alias("confidence"), _ordered_union("source_doc_ids", "ord").alias("source_doc_ids"), F.min("ord").alias("ord"))


def canonical_map(entities: DataFrame) -> DataFrame:
    """entity_id, canonical_id: the first (by ord) entity with the same stripped, lower-cased name."""
    rows = entities.select("entity_id", "ord", F.lower(stripped("name")).alias("_key"))
    return rows.join(rows.groupBy("_key").agg(F.min_by("entity_id", "ord").alias("canonical_id")), "_key").select("entity_id", "canonical_id").distinct()


def canonicalised(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triples whose ends are canonical; ends that the mapping lacks stay."""
    out = triples
    for end in ("head_id", "tail_id"):
        m = mapping.select(F.col("entity_id").alias(end), F.col("canonical_id").alias("_to"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.select(*triples.columns)
