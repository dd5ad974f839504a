"""Dense vectors as arrays of doubles, and hashed trigram embeddings as a relational operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products up to the shorter length, in order."""
    x, y = _c(a), _c(b)
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v))


def normalised(a: str | Column) -> Column:
    """To length 1; a zero vector stays.

    The vector and its length are bound to lambda variables: else the length would be computed again for each element.
    """
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    scaled = lambda v, n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return bound(_c(a), lambda v: bound(norm(v), lambda n: scaled(v, n)))


def lerp(a: str | Column, b: str | Column, t: float | Column) -> Column:
    """(1 - t) a + t b, cut to the shorter."""
    x, y = _c(a), _c(b)
    w = F.lit(t) if not isinstance(t, Column) else t
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: (1 - w) * p + w * q)


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Within [0, 1]: negative values count as 0, empty vectors too."""
    x, y = _c(a), _c(b)
    n = F.least(F.size(x), F.size(y))
    p, q = F.slice(x, 1, n), F.slice(y, 1, n)
    one = lambda v: F.when(v == 0, F.lit(1.0)).otherwise(v)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(0.0)).otherwise(unit(dot(p, q) / (one(norm(p)) * one(norm(q)))))


def blended(local: Column, parent: Column, weight: float) -> Column:
    return unit((1 - weight) * local + weight * parent)


def hashed_buckets(df: DataFrame, keys: list[str], text: str, dim: int = 256) -> DataFrame:
    """keys, bucket, weight: signed counts of hashed character trigrams, before normalising; all whole numbers.

    The text is lower-cased and padded with two spaces; a trigram's SHA-256 gives its bucket (first four
    bytes) and its sign (lowest bit of the fifth).  Trigrams are exploded and summed, partially in the tasks.
    """
    if dim < 16:
        raise ValueError("at least 16 dimensions")
    padded = F.concat(F.lit("  "), F.lower(F.col(text)), F.lit("  "))
    rows = df.filter(F.length(text) > 0).select(*keys, padded.alias("_p"))
    rows = rows.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("_p") - 2), lambda i: F.substring(F.col("_p"), i, 3))).alias("_t"))
    rows = rows.groupBy(*keys, "_t").agg(F.count("*").alias("_n"))
    h = F.sha2("_t", 256)
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    rows = rows.select(*keys, bucket.cast("int").alias("bucket"), (sign * F.col("_n")).cast("double").alias("_w"))
    return rows.groupBy(*keys, "bucket").agg(F.sum("_w").alias("weight")).filter("weight <> 0")


def hashed_embeddings(df: DataFrame, keys: list[str], text: str, dim: int = 256, name: str = "embedding") -> DataFrame:
    """keys and a normalised embedding; texts that are empty, or whose signs cancel, are left out (a zero vector)."""
    sparse = hashed_buckets(df, keys, text, dim)
    packed = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    cell = lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)) / F.col("_n")
    return packed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: cell(i.cast("int"))).alias(name))


def with_embeddings(df: DataFrame, keys: list[str], text: str, dim: int = 256, name: str = "embedding") -> DataFrame:
    """``df`` with an embedding for each row, zeros where there is none.  Keys identify rows."""
    out = df.join(hashed_embeddings(df, keys, text, dim, name), keys, "left")
    return out.withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0.0), dim)))


#: (rows, key columns, text column, name) -> rows with a vector called ``name``, of length 1 (or 0).
Embedder = Callable[[DataFrame, list[str], str, str], DataFrame]


def hashed(dim: int = 256) -> Embedder:
    """The embedder that needs no model: hashed trigrams."""
    return lambda df, keys, text, name: with_embeddings(df, keys, text, dim, name)
