"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source size copies.  Within its source, documents
are put in order of size (then of a hash), the expected copies are summed up from the first, one
random offset per source is added, and a document is emitted once for each integer that its
interval crosses.  Ordering by size keeps the words taken within about one document of the target.

Null texts and texts of white space have size 0 and take nothing; they hold places in the order.
A null source is a source of its own, the last one.  Repeated rows are separate documents.  Documents of equal size and id tie:
any order among them gives the same words.  Whole texts are counted, however long.  Empty tables give no rows.  Extra columns,
whatever their names, stay in ``mix_documents`` and are left out of ``plan_mix``.  Sources are one row each in the tables of
targets, which one task puts in order; documents are never gathered by source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import pieces, unused, with_unique_key
from factloom.plans.scratch import broadcast_below, materialise

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows of (range partition, source) counts that may be broadcast; a plain join beyond.
COUNT_ROWS = 200_000


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    id_type = docs.schema["doc_id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sizes = [0 if t is None else len(t.split()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])

    rows = docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, f"doc_id {id_type.simpleString()}, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: weighted shares, filled up like water below ``most`` times each source's size.

    With sources in order of limit / weight, the level is (total - limits so far) / (weights left)
    at the first source whose limit lies above it.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", "ord")
    every, before = Window.partitionBy(), by_level.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("ord", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size").cast("double") * most)
    s = s.withColumn("full_at", F.col("limit") / F.col("weight")).withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.min_by(F.when(F.col("full_at") > F.col("level"), F.col("level")), F.when(F.col("full_at") > F.col("level"), F.col("full_at"))).over(every))
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level"))).alias("target"))


def ranked(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size, rank (from 1 within its source, by size, then by a hash of the id).

    A range partitioning orders all rows; each task numbers its own rows, and the counts of earlier
    tasks are added.  No task sees more than a range of rows, however large one source is.
    """
    id_type = sizes.schema["doc_id"].dataType

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, n = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            places = []
            for source in b.column(1).to_pylist():
                n = n + 1 if source == last else 1
                last = source
                places.append(n)
            out = [b.column(0), b.column(1), b.column(2), pa.array([task] * b.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "source", "size", "task", "place"])

    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("h"), F.col("doc_id")]
    rows = sizes.withColumn("h", F.md5(F.col("doc_id").cast("string"))).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.select("doc_id", "source", "size").mapInArrow(number, f"doc_id {id_type.simpleString()}, source string, size long, task int, place long"), "places")
    counts = rows.groupBy("task", "source").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("task").alias("t"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    out = rows.join(broadcast_below(counts, COUNT_ROWS), (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", (F.col("before") + F.col("place")).alias("rank"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per document."""
    sizes = materialise(word_sizes(docs), "sizes")
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "s")
    rows = ranked(sizes).join(broadcast_below(targets, COUNT_ROWS), F.col("source").eqNullSafe(F.col("s")))
    named = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    offset = F.conv(F.substring(F.md5(named), 1, 4), 16, 10).cast("double") / 65536
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(F.col("rank") * each + offset) - F.floor((F.col("rank") - 1) * each + offset)).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Rows meet their copies by id, so texts are shuffled once.  If ids repeat (null ids count as equal), rows are written with a number
    first, and planned and joined by that.
    """
    own, copies, copy = unused(docs.columns, "id", "copies", "copy")
    rows, key = with_unique_key(docs)
    plan = plan_mix(rows.select(F.col(key).alias("doc_id"), "source", "text"), **options)
    plan = materialise(plan.filter("copies > 0").select(F.col("doc_id").alias(own), F.col("copies").alias(copies)), "copies")
    # Merged at every size: a small plan would be broadcast and then cost otherwise than a large one.
    out = rows.join(plan.hint("merge"), rows[key].eqNullSafe(plan[own]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
