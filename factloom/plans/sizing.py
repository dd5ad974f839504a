"""How many tasks a job is dealt over, by the size of what it reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.scratch import materialise

#: Bytes of compressed input files for each shuffle partition, and of compressed shuffled rows for each task.
BYTES_A_PARTITION, BYTES_A_TASK = 3 << 20, 4 << 20


def scaled(table: DataFrame) -> DataFrame:
    """``table``, read from files; the session's shuffle partitions are raised to its size, and tasks of adaptive plans kept small.

    A fixed number of partitions holds more in each task the larger the input, and facts of a few compressed bytes are some hundred
    in a sort or a hash table.  Numbers are raised and sizes lowered only, so small tables change nothing.
    """
    spark = table.sparkSession
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    partitions, advisory = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = math.ceil(size / BYTES_A_PARTITION)
    if wanted > int(spark.conf.get(partitions)):
        spark.conf.set(partitions, wanted)
    if size > BYTES_A_TASK and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(advisory)) > BYTES_A_TASK:
        spark.conf.set(advisory, f"{BYTES_A_TASK}b")
    return table


def dealt(df: DataFrame, keys: list[str], rows_a_task: int) -> DataFrame:
    """``df`` over one task for each ``rows_a_task`` rows, by a hash of its keys; for tables whose rows become many, or take long.

    ``df`` should be cheap to count.  Groups by these keys (and others) need no other shuffle.
    """
    return df.repartition(max(1, math.ceil(df.count() / rows_a_task)), *(F.col(k) for k in keys))


def once(rows: DataFrame, columns: list[str], added: dict[str, Column], rows_a_task: int) -> DataFrame:
    """``rows`` with columns that are long to compute from ``columns``: computed once for equal values, over many tasks."""
    values = materialise(rows.select(*columns).distinct(), "values")
    found = materialise(dealt(values, columns, rows_a_task).select(*columns, *(c.alias(name) for name, c in added.items())), "computed")
    found = found.select(*(F.col(c).alias(f"_{c}") for c in columns), *added)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return rows.join(found, same).drop(*(f"_{c}" for c in columns))
