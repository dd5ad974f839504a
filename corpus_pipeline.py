"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept, read again from Parquet.
Documents that the quality rules reject go, near-duplicate groups shrink to one document, documents
with benchmark passages go, sources are mixed by repeating or leaving out documents, and what is
left is dealt into shards.

All stages take null ids, texts, languages and sources, repeated rows and ids, very long texts, empty tables and extra columns of any
name: a null text fails the quality rules; repeated rows are near-duplicates; ids tell nothing but which document of a group stays
(the smallest, null last) and which labels a document has; extra columns stay.  Only the last stage adds columns (virtual_slot, shard,
map_version), in place of any that are called so.

The slot map is made anew, unless spark.factloom.slotMap names a folder where it is kept: then the latest version is rebalanced
and, if that moves slots, stored as the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontamination, mixing, quality, sharding, simhash
from factloom.plans.scratch import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, map_path=spark.conf.get("spark.factloom.slotMap", None))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("sharding", shards),
]

#: XXH64, certified cutoffs and slot maps have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
