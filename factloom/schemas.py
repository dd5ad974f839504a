"""Table schemas and field checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENTS = "doc_id STRING, title STRING, text STRING, metadata MAP<STRING,STRING>, embedding ARRAY<DOUBLE>"
ENTITY_INDEX = "doc_id STRING, ord BIGINT, id STRING, name STRING"
CLASSES = "class_id STRING, name STRING, description STRING, parent_ids ARRAY<STRING>, aliases ARRAY<STRING>, attributes MAP<STRING,STRING>"
RELATIONS = "relation_id STRING, name STRING, description STRING, domain STRING, range STRING, direction STRING, symmetric BOOLEAN, transitive BOOLEAN, aliases ARRAY<STRING>"
RULES = "rule_id STRING, name STRING, expression STRING, description STRING, confidence DOUBLE"
PROPOSALS = (
    "doc_id STRING, chunk_index INT, reply STRUCT<entity_types: ARRAY<STRUCT<name: STRING, description: STRING, parent_names: ARRAY<STRING>, aliases: ARRAY<STRING>>>, "
    "relations: ARRAY<STRUCT<name: STRING, description: STRING, domain: STRING, range: STRING, direction: STRING, symmetric: BOOLEAN, transitive: BOOLEAN>>, notes: STRING>"
)
OUTPUTS = (
    "doc_id STRING, strategy STRING, reply STRUCT<entities: ARRAY<STRUCT<name: STRING, type_name: STRING, description: STRING, aliases: ARRAY<STRING>>>, "
    "triples: ARRAY<STRUCT<head: STRING, relation: STRING, tail: STRING, evidence: STRING, confidence: DOUBLE>>, notes: STRING>"
)
ENTITIES = "entity_id STRING, name STRING, type_id STRING, aliases ARRAY<STRING>, description STRING, source_doc_ids ARRAY<STRING>, confidence DOUBLE, embedding ARRAY<DOUBLE>, ord BIGINT"
TRIPLES = "triple_id STRING, head_id STRING, relation_id STRING, tail_id STRING, evidence STRING, source_doc_ids ARRAY<STRING>, strategy STRING, confidence DOUBLE, is_verified BOOLEAN, ord BIGINT"
QUERIES = "query_id BIGINT, raw_query STRING"

DIRECTIONS = ("directed", "undirected", "bidirectional")
STRATEGIES = ("tot", "open_ie", "loose")
LEVELS = ("syntactic", "semantic", "evidential")


def valid_name(name: str | Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(name) != "", F.lit(False))


def in_unit_range(value: str | Column) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.between(0, 1), F.lit(False))


def violations(df: DataFrame, names: tuple[str, ...] = (), units: tuple[str, ...] = (), choices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows that break a field rule, with the names of the fields in ``broken``."""
    checks = [F.when(~valid_name(c), F.lit(c)) for c in names] + [F.when(~in_unit_range(c), F.lit(c)) for c in units]
    checks += [F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.lit(c)) for c, v in (choices or {}).items()]
    return df.withColumn("broken", F.array_compact(F.array(*checks))).filter(F.size("broken") > 0)
