"""Every vector of one table against every vector of another, by blocks: exact, in bounded memory, over many tasks.

Rows are dealt into groups by a hash of their key.  A task holds two groups and compares them by matrix products, so pairs
are never shuffled; a vector is shuffled once for each group it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors, as doubles, that a group has about; a task holds two groups.
GROUP_BYTES = 64 << 20
#: Groups of a table that is compared with itself, at least: 36 tasks.
LEAST_GROUPS = 8
#: Rows and columns of a matrix product.
TILE = 1024, 8192


def groups_of(rows: int, dim: int, least: int = 1, group_bytes: int = GROUP_BYTES) -> int:
    """How many groups hold ``rows`` vectors of ``dim`` doubles."""
    return max(least, math.ceil(rows * max(dim, 1) * 8 / group_bytes))


class Vectors:
    """Keys and vectors of one length, with the lengths' inverses (0 vectors have 1, as their cosine is 0)."""

    def __init__(self, keys: pa.Array, matrix: np.ndarray):
        self.keys, self.matrix = keys, matrix

    def cut(self, n: int) -> np.ndarray:
        """Rows of length 1 (or 0), of the first ``n`` cells."""
        m = self.matrix[:, :n]
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        norm[norm == 0] = 1.0
        return m / norm[:, None]


def by_length(rows: pa.Table) -> list[Vectors]:
    """The rows (id, v) as a matrix for each length of vector; rows without a vector have length 0."""
    v = rows["v"].combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    sizes = np.asarray(v.value_lengths().fill_null(0))
    keys, out = rows["id"], []
    for n in np.unique(sizes):
        at = pa.array(np.flatnonzero(sizes == n))
        cells = v.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        out.append(Vectors(keys.take(at), cells.reshape(len(at), n)))
    return out


def products(x: Vectors, y: Vectors) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of x, first row of y, cosines), a tile at a time; vectors are cut to the shorter length, and an empty one gives 0."""
    n = min(x.matrix.shape[1], y.matrix.shape[1])
    a, b = x.cut(n), y.cut(n).T
    for i in range(0, a.shape[0], TILE[0]):
        for j in range(0, b.shape[1], TILE[1]):
            yield i, j, a[i : i + TILE[0]] @ b[:, j : j + TILE[1]]


def within(rows: DataFrame, groups: int, each: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """``each`` of every two groups of ``rows`` (id, v), and of each group with itself (the last argument tells)."""
    g = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("o")
    dealt = rows.select("id", "v", g.alias("g"), other)
    dealt = dealt.select("id", "v", "g", (F.least("g", "o") * groups + F.greatest("g", "o")).alias("task"))

    def run(t: pa.Table) -> pa.Table:
        task, g = t["task"][0].as_py(), np.asarray(t["g"])
        low, high = divmod(task, groups)
        a = t.take(pa.array(np.flatnonzero(g == low)))
        return each(a, a if low == high else t.take(pa.array(np.flatnonzero(g == high))), low == high)

    return dealt.groupBy("task").applyInArrow(run, schema)


def between(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], left_groups: int, right_groups: int, each: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``each`` of every group of ``left`` with every group of ``right``; both have the same columns."""
    g = lambda keys, n: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("g")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o")
    a = left.select("*", F.lit(True).alias("first"), g(left_keys, left_groups), other(right_groups)).withColumn("task", F.col("g") * right_groups + F.col("o"))
    b = right.select("*", F.lit(False).alias("first"), g(right_keys, right_groups), other(left_groups)).withColumn("task", F.col("o") * right_groups + F.col("g"))
    dealt = a.unionByName(b).drop("g", "o")
    return dealt.groupBy("task").applyInArrow(lambda t: each(t.filter(t["first"]), t.filter(pc.invert(t["first"]))), schema)
