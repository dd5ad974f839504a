"""Tables written once and read again, in the folder all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``.  A lost executor then
costs a re-read, never a recomputation of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, BinaryType, NumericType, StringType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set (tests, laptops)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="factloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/factloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes, about, that a broadcast table may have.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, ArrayType):
            size += F.coalesce(F.size(c), F.lit(0)) * (8 if isinstance(f.dataType.elementType, NumericType) else 64) + 16
        else:
            size += 8 if isinstance(f.dataType, AtomicType) else 256
    return size


def broadcast_below(df: DataFrame, rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``most_bytes``, else with a merge hint: both sides are shuffled.

    ``df`` should be cheap to count: a materialised table or a small aggregate.
    """
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most_bytes else df.hint("merge")
