"""SimHash near-duplicates, found through deletion variants.

Two fingerprints with at most four differing bits, cut into three segments, have a segment that
differs in at most one bit.  So each distinct fingerprint is indexed under every segment with one
bit wiped out, 64 keys in all, and fingerprints that share a key are compared in full.

A key whose wiped bit lies in one half of a segment has the other half whole.  So only six rows a fingerprint are dealt, one for each
half (a bucket is a half and its bits), and the 10 or 11 keys with wiped bits in the other half are made and sorted as
arrays where a bucket arrives.  Equal fingerprints are one node, however many documents have them.  A bucket of more than
``BLOCK`` fingerprints is dealt into blocks, and each pair of blocks is a task's work.  Of the links found a spanning forest is
given, not all pairs.  Components come from plans.components.

Documents with fewer than four words hash their whole word sequence; without words (null texts
too) the fingerprint is zero and links like any other.  Repeated rows are nodes alike.
A null doc_id never is a component's id unless all ids in it are null; an id "null" is another.  Equal fingerprints tie: all
their documents have one component.  Whole texts are hashed, however long.  Extra columns, whatever their names, stay in
``keep_one`` and are left out of ``near_duplicates``.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from factloom.llm.common import LOWER, pieces, unused
from factloom.plans.components import components
from factloom.plans.scratch import materialise

SHINGLE, DISTANCE, SEED, BITS = 4, 4, 42, 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (start, width) of a half that is held whole and of the other half of its segment, which has the wiped bit; at most HALF bits each.
HALVES = tuple(pair for at, n in SEGMENTS for low, high in [((at, n // 2), (at + n // 2, n - n // 2))] for pair in ((low, high), (high, low)))
HALF = 11
BLOCK = 20_000
CHUNK = 1 << 16
#: Keys of up to so many fingerprints are compared by lags, many keys at a time.
LAGS = 128


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes


def fingerprint(text: bytes | None) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
    n = len(words) - SHINGLE + 1
    votes = bit_votes(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))
    return int(((2 * votes > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, fp long")


def buckets(fp: Column) -> Column:
    """Six numbers: which half is held whole, and its bits."""
    return F.array(*(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << HALF)).cast("int") for k, ((start, width), _) in enumerate(HALVES)))


def spanning_links(own: np.ndarray, other: np.ndarray | None, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A forest that connects what fingerprints within ``distance`` of each other connect.

    With ``other``, only links across count, but any that are seen may be used.
    """
    left = np.unique(own if other is None else np.concatenate([own, other])).view(np.uint64)
    links, queue = [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[-1]], left[:-1]
            continue
        if not len(left):
            break
        node = queue.pop()
        near = np.bitwise_count(left ^ node) <= distance
        if near.any():
            found = left[near]
            links += [(int(node.view(np.int64)), int(x)) for x in found.view(np.int64)]
            queue += list(found)
            left = left[~near]
    return links


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which of the links u, v (pairs of places below n) to keep, so that they connect what all of them connect."""
    root, left, kept = np.arange(n), np.arange(len(u)), []
    while True:
        a, b = root[u[left]], root[v[left]]
        live = a != b
        if not live.any():
            return np.concatenate(kept) if kept else left[:0]
        left, high, low = left[live], np.maximum(a, b)[live], np.minimum(a, b)[live]
        one = np.unique(high, return_index=True)[1]  # each root is hung below a smaller one, once
        kept.append(left[one])
        root[high[one]] = low[one]
        while not np.array_equal(root[root], root):
            root = root[root]


def near_pairs(fp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in fp) that connect what is near in the groups that end before ``ends``; all groups at a time, one lag after the other."""
    last = np.repeat(ends, np.diff(ends, prepend=0))  # where each row's group ends
    u, v, at, lag = [], [], np.arange(len(fp)), 1
    while len(at := at[at + lag < last[at]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= DISTANCE]
        u.append(near)
        v.append(near + lag)
        lag += 1
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    kept = forest(u, v, len(fp))
    return u[kept], v[kept]


def bucket_links(fp: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprints) within buckets that end before ``ends``; ``which`` says for each bucket which half its rows share."""
    sizes = np.diff(ends, prepend=0)
    start, width = (np.repeat(np.array([other[k] for _, other in HALVES])[which], sizes) for k in range(2))
    value = (fp >> start.astype(np.uint64)).astype(np.int64) & ((1 << width) - 1)
    bucket = np.repeat(np.arange(len(ends)) << HALF, sizes)
    u, v, large = [], [], []
    for wiped in range(HALF):
        rows = np.flatnonzero(width > wiped)
        keys = bucket[rows] | value[rows] & ~(1 << wiped)
        order = np.argsort(keys, kind="stable")
        rows, keys = rows[order], keys[order]
        stops = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(stops, prepend=0)
        small = counts <= LAGS
        few = rows[np.repeat(small, counts)]
        a, b = near_pairs(fp[few], counts[small].cumsum())
        u.append(few[a])
        v.append(few[b])
        for stop, n in zip(stops[~small].tolist(), counts[~small].tolist(), strict=True):
            large += spanning_links(fp[rows[stop - n : stop]].view(np.int64), None)
    u, v = np.concatenate(u), np.concatenate(v)
    kept = forest(u, v, len(fp))
    more = np.array(large, np.int64).reshape(-1, 2)
    return np.concatenate([fp[u[kept]].view(np.int64), more[:, 0]]), np.concatenate([fp[v[kept]].view(np.int64), more[:, 1]])


def _links_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, i, j); those of a batch and of one open bucket are held: at most two blocks."""

    def found(parts: list[np.ndarray], ends: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        u, v = bucket_links(np.concatenate(parts).view(np.uint64), ends, which)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    last, parts, held = None, [], 0  # the open bucket, its rows and their number
    for b in batches:
        bucket, i, j, fp = (b.column(k).to_numpy() for k in range(4))
        if not len(fp):
            continue
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        if held and (bucket[0], i[0], j[0]) != last:
            cuts = np.append(0, cuts)
        if len(cuts):
            which = bucket[cuts - 1] >> HALF
            which[0] = (last if held else bucket)[0] >> HALF
            yield found([*parts, fp[: cuts[-1]]], cuts + held, which)
            parts, held = [], 0
        rest = fp[cuts[-1] :] if len(cuts) else fp
        parts.append(rest.copy())
        held += len(rest)
        last = (bucket[-1], i[-1], j[-1])
    if held:
        yield found(parts, np.array([held]), np.array([last[0] >> HALF]))


def near_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: links that connect every pair of distinct fingerprints (column fp) within the distance."""
    dealt = nodes.select("fp", F.explode(buckets(F.col("fp"))).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = dealt.join(F.broadcast(materialise(sizes, "buckets")), "bucket").withColumn("own", own)  # 6 << HALF buckets at most
    # Block b meets every block i: the pair (least, greatest) is a group of its own.
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "i").alias("i"), F.greatest("own", "i").alias("j"), "fp")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.mapInArrow(_links_of_buckets, "u long, v long").distinct()


def components_of(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, component (a fingerprint), component_id (smallest doc_id of all that links reach) from doc_id and fp of all documents."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # Six rows are exploded from each of these small rows, so they are dealt to as many tasks as any shuffle has.
    nodes = materialise(nodes.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"), "nodes")
    roots = components(near_links(nodes, block)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of all that links reach)."""
    prints = materialise(fingerprints(docs), "fingerprints")
    return prints.join(components_of(prints, block), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_fingerprints(rows: DataFrame, name: str) -> DataFrame:
    at, names = rows.columns.index("text"), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = np.array([fingerprint(t) for t in b.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*names, name])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add(name, LongType()))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row per component: one of its smallest (doc_id, fingerprint), null ids last.

    Rows of an id that no other row has are found by the id.  Only rows of repeated ids (null ids, if there are several) are
    fingerprinted again to tell them apart; of those equal in id and fingerprint one stays.
    """
    own, fp = unused(docs.columns, "id", "fp")
    prints = materialise(fingerprints(docs), "fingerprints")
    found = prints.join(components_of(prints, block).select("fp", "component"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    chosen = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias(own), F.col("first.fp").alias(fp))
    repeated = materialise(prints.groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("n")).filter("n > 1").select(own), "repeated")
    same_id = lambda other: docs["doc_id"].eqNullSafe(other[own])
    if repeated.isEmpty():
        return docs.join(chosen, same_id(chosen), "left_semi")
    chosen = materialise(chosen, "chosen")
    single = chosen.join(repeated.withColumnRenamed(own, fp + "_"), F.col(own).eqNullSafe(F.col(fp + "_")), "left_anti")
    rows = with_fingerprints(docs.join(repeated, same_id(repeated), "left_semi"), fp)
    chosen = chosen.withColumnRenamed(fp, fp + "_")
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen[own]) & (rows[fp] == chosen[fp + "_"]), "left_semi")
    rows = rows.groupBy("doc_id", fp).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64("text")).alias(own)).select(f"{own}.*")
    return docs.join(single, same_id(single), "left_semi").unionByName(rows)
