"""Documents, JSON and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schemas import DOCUMENTS


def from_texts(spark: SparkSession, texts: list[str | tuple[str, str]]) -> DataFrame:
    """doc_id, text from strings or (id, text) pairs; bare strings are doc_0, doc_1, ... by place."""
    rows = [(f"doc_{i}", t) if isinstance(t, str) else tuple(t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file: one value or an array of objects."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of files with one JSON object a line, for read_jsonl."""
    rows.write.mode(mode).json(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines; rows without text are left out, missing ids come from the text."""
    rows = read_jsonl(spark, path, DOCUMENTS).filter(F.trim("text") != "")
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha1("text"), 1, 12))))


@dataclass(frozen=True)
class EngineSettings:
    """All knobs in one place.  Unknown keys of a file go to ``extras``."""

    chunk_size: int = 4000
    chunk_overlap: int = 400
    min_class_support: int = 1
    min_relation_support: int = 1
    strategies: tuple[str, ...] = ("tot", "open_ie", "loose")
    consensus_strategies: int = 2
    anchor_threshold: float = 0.90
    evidence_threshold: float = 0.90
    grounding_threshold: float = 0.75
    hierarchy_levels: int = 3
    min_community_size: int = 2
    parent_blend: float = 0.4
    beam_width: int = 3
    embedding_dim: int = 256
    extras: dict = field(default_factory=dict)


def load_settings(path: str) -> EngineSettings:
    """From JSON, or from YAML where a YAML library is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise RuntimeError("reading YAML needs a YAML library; JSON works without") from e
        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    names = {f.name for f in fields(EngineSettings)} - {"extras"}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names}
    return EngineSettings(**known, extras={k: v for k, v in raw.items() if k not in names})


def settings_dict(settings: EngineSettings) -> dict:
    return asdict(settings)
