"""What the corpus operators share: words as bytes, Arrow batches in small pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.scratch import materialise

#: Lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: bytes.split() cuts at exactly 0x20 and 0x09-0x0D, whatever the encoding of the rest is.
TEXT_BYTES = 4 << 20


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()  # texts come in batches of tens of MB; two workers share an executor


def rows_to_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """Tuples to a record batch."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unused(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with underscores in front until no column is called so, in either case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_unique_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart: doc_id, or if ids repeat (null ids count as equal) a new column of row numbers.

    Numbered rows are written, so that the numbers stay what they are.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # reads ids only
        return docs, "doc_id"
    (key,) = unused(docs.columns, "row")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "numbered-rows"), key
