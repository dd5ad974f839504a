"""Row numbers over a whole table without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.scratch import broadcast_below, materialise


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: its place from 0 in the given order.

    A range partitioning orders the rows, each task numbers its own, and the counts of earlier tasks are added.
    The order should be total; rows that tie get some order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_task", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = materialise(rows, "numbered")
    counts = rows.groupBy("_task").agg(F.count("*").alias("_n"))  # a row per task
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = rows.join(broadcast_below(counts, 200_000), "_task")
    return out.withColumn(name, F.col("_before") + F.col("_place")).drop("_task", "_place", "_before")
