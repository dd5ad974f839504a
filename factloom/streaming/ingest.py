"""A growing schema from a stream of documents.

Chunking is stateless and runs on the stream itself.  What is proposed for each micro-batch is merged into
class counts kept as versioned tables: a batch reads version n and writes n + 1, so a batch that is
repeated after a failure overwrites its own version and counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import ontology
from factloom.schemas import PROPOSALS

REPLY = PROPOSALS.split("reply ", 1)[1]


def merged_support(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Class support (key, name, description, parents, aliases, support) of ``known`` plus a batch; what is known stands first."""
    if known is None:
        return batch
    rows = known.withColumn("_o", F.lit(0)).unionByName(batch.withColumn("_o", F.lit(1)))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  two rows a key at most
    return rows.groupBy("key").agg(
        F.min_by("name", "_o").alias("name"), F.coalesce(F.min_by(F.nullif("description", F.lit("")), F.when(F.col("description") != "", F.col("_o"))), F.lit("")).alias("description"),
        union("parents"), union("aliases"), F.sum("support").alias("support"),
    )


def load_support(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version:09d}")


def grow_schema(documents: DataFrame, proposer: Callable[[str], dict], path: str, checkpoint: str, size: int = 4000, overlap: int = 400, **trigger) -> StreamingQuery:
    """Starts a query that keeps class support up to date below ``path``; ``documents`` streams doc_id and text."""
    chunked = ontology.chunks(documents, size, overlap)

    def batch(rows: DataFrame, number: int) -> None:
        support = ontology.class_support(ontology.propose(rows, proposer, REPLY).filter("reply IS NOT NULL"))
        known = load_support(rows.sparkSession, path, number - 1) if number else None
        merged_support(known, support).write.mode("overwrite").parquet(f"{path}/version={number:09d}")

    return chunked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
