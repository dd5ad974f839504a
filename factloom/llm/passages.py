"""Fuzzy repeated passages by collinear chaining.

Seeds are five-word k-mers, thinned by winnowing: of every ``WINNOW`` consecutive k-mers at least one
stays, so a run of WINNOW + 4 equal words always shares a seed.  Each seed is joined to the
first document (smallest id) that has it, never to all others: a hot passage gives as many
rows as it has occurrences.  For each pair of documents, a Fenwick tree over the positions in the
earlier one finds the best chains of matches in order, longer gaps costing more.  Chains are aligned
word by word between their seeds and extended at the ends; those of ``IDENTITY`` or more are
passages.  Overlapping passages join, and those of at least ``MIN_WORDS`` words count.

A seed's first document comes from an aggregate with partial sums, so a hot seed costs each
task one row, and the join back is one that Spark splits where it is skewed.

Null texts and texts under five words have no seeds.  Passages repeated within a document only
don't count.  Rows that share an id count as one document, rows without an id have no passages.
Words are runs without white space, A-Z lower-cased.  Chains of equal score go by place.  Whole texts count, however long.  Ids of any orderable type will do; those that aren't whole numbers are numbered
in order first.  Empty tables give no rows; extra columns, whatever their names, are left out.

Seeds, chains of two and ten words at least find 0.9 or more of the passages of 50 words and 0.8 identity (tests/llm/test_passages.py).
A passage whose sentences first stand in different documents keeps the seeds across their borders: most of such passages are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factloom.llm.common import LOWER, pieces, rows_to_batch
from factloom.plans.components import components
from factloom.plans.ranking import numbered
from factloom.plans.scratch import materialise

K, WINNOW, MAX_GAP, IDENTITY, MIN_WORDS, MIN_CHAIN = 5, 6, 50, 0.8, 50, 10
#: Aligned passages of fewer words don't count, not even as parts of longer ones.
MIN_PART = 20
#: Words fetched beyond a chain's ends: more than winnowing can leave out.
MARGIN = 50
#: An extension ends this far below its best score.
DROP = 8
#: A seed's worth is K; each word of gap, on either side, costs this much.
GAP_COST = 0.05
KNOWN = 500_000
MAP_BITS = 1 << 22


class WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = xxhash.xxh64_intdigest(word, 42)
        return code


def word_codes(text: bytes | None, codes: WordCodes) -> np.ndarray:
    words = text.translate(LOWER).split() if text else []
    if len(codes) > KNOWN:
        codes.clear()
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def kmers(words: np.ndarray) -> np.ndarray:
    n = len(words) - K + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(K if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least k-mer of every window."""
    if len(hashes) <= WINNOW:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, WINNOW).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def occurrence_seeds(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds with how often they came before mixed in, and which came before."""
    order = np.argsort(own, kind="stable")
    new = np.append(True, own[order[1:]] != own[order[:-1]]) if len(own) else np.zeros(0, bool)
    before = np.empty(len(own), np.uint64)
    before[order] = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    return own ^ (before * np.uint64(0x9E3779B97F4A7C15)), np.flatnonzero(before)


def seeds(docs: DataFrame) -> DataFrame:
    """h, doc, pos, and whether the seed may anchor others.

    The second, third and further places of a k-mer in a document are seeds of their own, so that texts that repeat
    themselves meet place by place; they also meet the first place of an earlier document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in pieces(batches):
            ids, hs, ps, fs = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = kmers(word_codes(text, codes))
                at = winnowed(h)
                own, again = occurrence_seeds(h[at])
                ids.append(np.full(len(at) + len(again), doc, np.int64))
                hs.append(np.concatenate([own, h[at[again]]]).view(np.int64))
                ps.append(np.concatenate([at, at[again]]).astype(np.int32))
                fs.append(np.arange(len(at) + len(again)) < len(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, ps, fs)], ["h", "doc", "pos", "first"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "h long, doc long, pos int, first boolean")


def matches(seed_rows: DataFrame) -> DataFrame:
    """doc, anchor, pos, apos: each seed's place, and its place in the first document that has it."""
    firsts = seed_rows.filter("first").groupBy("h").agg(F.min("doc").alias("anchor"), F.min_by("pos", "doc").alias("apos"), F.max("doc").alias("last"))
    # Written, so that the join has a shuffle of its own on each side, which Spark can split where it is skewed.
    shared = materialise(firsts.filter("anchor <> last").select("h", "anchor", "apos"), "shared-seeds")
    return seed_rows.join(shared, "h").filter("doc <> anchor").select("doc", "anchor", "pos", "apos")


def best_chains(pos: list[int], apos: list[int]) -> list[list[int]]:
    """Chains (lists of match numbers) of matches that increase on both sides, best first; each match is in one.

    ``pos`` increases strictly.  The Fenwick tree holds, by rank of apos, the greatest
    score + GAP_COST * (pos + apos); from it a later match subtracts its own GAP_COST * (pos + apos).
    """
    rank = {a: i + 1 for i, a in enumerate(sorted(set(apos)))}
    size = len(rank)
    top, arg = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [], []
    for i, (p, a) in enumerate(zip(pos, apos, strict=True)):
        r = rank[a] - 1
        best, j = -1e18, -1
        while r > 0:
            if top[r] > best:
                best, j = top[r], arg[r]
            r &= r - 1
        reach = GAP_COST * (p + a)
        if best - reach <= 0:
            best, j = reach, -1
        score.append(K + best - reach)
        before.append(j)
        value, r = score[i] + reach, rank[a]
        while r <= size:
            if value > top[r]:
                top[r], arg[r] = value, i
            r += r & -r
    used, out = [False] * len(pos), []
    for i in sorted(range(len(pos)), key=lambda x: (-score[x], x)):
        chain = []
        while i >= 0 and not used[i]:
            if chain and (pos[chain[-1]] - pos[i] > MAX_GAP or apos[chain[-1]] - apos[i] > MAX_GAP):
                break
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def chained(pairs: DataFrame) -> DataFrame:
    """doc, anchor, ps, aps: the chains of at least MIN_CHAIN words.  One pair of documents is held at a time."""
    schema = pa.schema([("doc", pa.int64()), ("anchor", pa.int64()), ("ps", pa.list_(pa.int32())), ("aps", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close(rows: list) -> None:
            pos = np.concatenate([h[0] for h in held])
            if len(pos) < 2:
                return
            apos = np.concatenate([h[1] for h in held])
            p, a = pos.tolist(), apos.tolist()
            for chain in best_chains(p, a):
                if len(chain) > 1 and p[chain[-1]] - p[chain[0]] + K >= MIN_CHAIN:
                    rows.append((*key, [p[i] for i in chain], [a[i] for i in chain]))

        rows: list = []
        for b in batches:
            doc, anchor, pos, apos = (b.column(i).to_numpy() for i in range(4))
            if not len(doc):
                continue
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(anchor) != 0)) + 1
            for x, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
                if (doc[x], anchor[x]) != key:
                    if held:
                        close(rows)
                    key, held = (doc[x], anchor[x]), []
                held.append((pos[x:z], apos[x:z]))
            yield rows_to_batch(rows, schema)
            rows = []
        if held:
            close(rows)
        yield rows_to_batch(rows, schema)

    dealt = pairs.repartition("doc").groupBy("doc", "anchor", "pos").agg(F.max("apos").alias("apos")).sortWithinPartitions("doc", "anchor", "pos")
    return dealt.mapInArrow(run, "doc long, anchor long, ps array<int>, aps array<int>")


def involved_words(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, words (32 bits of each word's hash) for documents in ``ids`` (and a few more: a bitmap of fixed size decides)."""
    bit = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    parts = ids.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("long")).alias("bits"))
    mask = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.collect():  # at most MAP_BITS / 32768 rows of 4 KB
        mask[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = WordCodes(), shared.value
        for b in pieces(batches):
            number = b.column(2).to_numpy()
            want = np.flatnonzero(bits[number >> 3] >> (number & 7).astype(np.uint8) & 1)
            texts = b.column(1)
            words = [word_codes(texts[int(i)].as_py(), codes).astype(np.uint32).view(np.int32) for i in want]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(want)), pa.array(words, pa.list_(pa.int32()))], ["doc", "words"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    return rows.withColumn("bit", F.pmod(F.xxhash64("doc"), F.lit(MAP_BITS))).mapInArrow(run, "doc long, words array<int>")


def edit_distance(a: list[int], b: list[int]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner if x == y else 1 + min(corner, row[j], row[j - 1])
    return row[-1]


def extend(left: list[int], right: list[int], x: int, y: int, step: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Words to add in one direction (and how many of them match) until mismatches outweigh matches."""
    score = best = n = matched = 0
    found = (0, 0)
    while low[0] <= x < high[0] and low[1] <= y < high[1] and score > best - DROP:
        same = left[x] == right[y]
        score += 1 if same else -2
        matched, n = matched + same, n + 1
        if score > best:
            best, found = score, (n, matched)
        x, y = x + step, y + step
    return found


def aligned(left: list[int], right: list[int], pos: list[int], apos: list[int]) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) of the passages along one chain, with places in ``left`` and ``right``."""
    parts, now = [], None
    for p, q in zip(pos, apos, strict=True):
        if now is not None:
            x, y = now[1], now[3]
            if p < x or q < y:
                if p - x == q - y and p + K > x:
                    now[1], now[3], now[4], now[5] = p + K, q + K, now[4] + p + K - x, now[5] + p + K - x
                continue
            gap = max(p - x, q - y)
            same = gap - (0 if left[x:p] == right[y:q] else edit_distance(left[x:p], right[y:q])) if gap else 0
            if gap < 10 or same >= 0.4 * gap:
                now[1], now[3], now[4], now[5] = p + K, q + K, now[4] + same + K, now[5] + gap + K
                continue
        now = [p, p + K, q, q + K, K, K]
        parts.append(now)
    out, low = [], (0, 0)
    for i, (s, e, t, f, matched, columns) in enumerate(parts):
        high = (parts[i + 1][0], parts[i + 1][2]) if i + 1 < len(parts) else (len(left), len(right))
        back, m1 = extend(left, right, s - 1, t - 1, -1, low, high)
        on, m2 = extend(left, right, e, f, 1, low, high)
        low = (e + on, f + on)
        if e + on - (s - back) >= MIN_PART and (matched + m1 + m2) >= IDENTITY * (columns + back + on):
            out.append((s - back, e + on, t - back, f + on))
    return out


def passages(docs: DataFrame) -> DataFrame:
    """doc, start, end, anchor, anchor_start, anchor_end (words, ends exclusive) of aligned passages; short ones too."""
    chains = materialise(chained(matches(seeds(docs))), "chains")  # seeds are made twice: they would take as much disk as the texts
    ids = chains.select(F.col("doc").alias("id")).unionByName(chains.select(F.col("anchor").alias("id"))).distinct()
    words = materialise(involved_words(docs, ids), "words")

    def region(side: str, places: str) -> list:
        start = F.greatest(F.lit(0), F.element_at(places, 1) - MARGIN)
        size = F.element_at(places, -1) + (K + MARGIN) - start
        return [start.alias(f"{side}_from"), F.slice("words", start + 1, size).alias(side)]

    kept = [F.col(c) for c in ("doc", "anchor", "ps", "aps")]
    rows = chains.join(words, "doc").select(*kept, *region("left", "ps"))
    rows = rows.join(words.withColumnRenamed("doc", "anchor"), "anchor").select(*kept, "left_from", "left", *region("right", "aps"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "start", "end", "anchor", "anchor_start", "anchor_end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            out = []
            for doc, anchor, ps, aps, x, left, y, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # A row of another text with the same id can be too short for the chain.
                if ps[-1] + K - x <= len(left) and aps[-1] + K - y <= len(right):
                    for s, e, t, f in aligned(left, right, [p - x for p in ps], [a - y for a in aps]):
                        out.append((doc, s + x, e + x, anchor, t + y, f + y))
            yield rows_to_batch(out, schema)

    return materialise(rows.mapInArrow(run, "doc long, start long, end long, anchor long, anchor_start long, anchor_end long"), "passages")


def merged_spans(intervals: DataFrame) -> DataFrame:
    """id, side, n_words, spans: intervals (id, side, start, end) joined where they meet; those of MIN_WORDS or more stay.

    Intervals stream by in order, so what is held is one document's joined spans.
    """
    schema = pa.schema([("id", pa.int64()), ("side", pa.int32()), ("n_words", pa.int64()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spans = None, []

        def row() -> list:
            long = [(s, e) for s, e in spans if e - s >= MIN_WORDS]
            return [(*key, sum(e - s for s, e in long), ",".join(f"{s}:{e}" for s, e in long))] if long else []

        for b in batches:
            out = []
            for i, side, s, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (i, side) != key:
                    out += row() if key else []
                    key, spans = (i, side), []
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], e))
                else:
                    spans.append((s, e))
            yield rows_to_batch(out, schema)
        yield rows_to_batch(row() if key else [], schema)

    dealt = intervals.distinct().repartition("id", "side").sortWithinPartitions("id", "side", "start", "end")
    return dealt.select("id", "side", "start", "end").mapInArrow(run, "id long, side int, n_words long, spans string")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_repeated and repeated_spans (words that an earlier document has), earlier_ids,
    n_first and first_spans (words that later documents repeat), n_links (documents it is linked to), class_id
    (smallest id that links reach; its own without links).
    """
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return _repeated(docs.select("doc_id", "text"))
    ids = numbered(docs.select(F.col("doc_id").alias("id")).filter("id IS NOT NULL").distinct(), ["id"], "number")
    ids = materialise(ids.select("id", "number"), "ids")
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left")
    found = materialise(_repeated(rows.select(F.col("number").alias("doc_id"), "text")), "by-number")
    earlier = found.select("doc_id", F.explode("earlier_ids").alias("number")).distinct().join(ids, "number")
    earlier = earlier.groupBy("doc_id").agg(F.sort_array(F.collect_list("id")).alias("earlier"))
    out = found.join(earlier, "doc_id", "left").join(ids, F.col("doc_id") == F.col("number"), "left").drop("number")
    out = out.join(ids.select(F.col("id").alias("of_class"), "number"), F.col("class_id") == F.col("number"), "left")
    columns = {"doc_id": F.col("id"), "earlier_ids": F.coalesce("earlier", F.array().cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")), "class_id": F.col("of_class")}
    return out.select(*(columns.get(c, F.col(c)).alias(c) for c in found.columns))


def _repeated(docs: DataFrame) -> DataFrame:
    found = passages(docs)
    repeated, first = F.lit(0).alias("side"), F.lit(1).alias("side")
    sides = found.select(F.col("doc").alias("id"), repeated, "start", "end").unionByName(found.select(F.col("anchor").alias("id"), first, F.col("anchor_start").alias("start"), F.col("anchor_end").alias("end")))
    spans = materialise(merged_spans(sides), "spans")
    # A link counts if its document's joined spans count.
    long = spans.filter("side = 0").select(F.col("id").alias("doc"))
    links = materialise(found.select("doc", "anchor").distinct().join(long, "doc"), "links")
    ends = links.groupBy(F.col("doc").alias("id")).agg(F.sort_array(F.collect_list("anchor")).alias("earlier_ids"), F.count("*").alias("up"))
    ends = ends.join(links.groupBy(F.col("anchor").alias("id")).agg(F.count("*").alias("down")), "id", "full")
    classes = components(links.select(F.col("doc").alias("u"), F.col("anchor").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("class_id"))
    by_side = spans.filter("side = 0").select("id", F.col("n_words").alias("n_repeated"), F.col("spans").alias("repeated_spans"))
    by_side = by_side.join(spans.filter("side = 1").select("id", F.col("n_words").alias("n_first"), F.col("spans").alias("first_spans")), "id", "full")
    about = by_side.join(ends, "id", "full").join(classes, "id", "left")
    rows = docs.select("doc_id").join(about, F.col("doc_id").cast("long") == F.col("id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "doc_id", zero("n_repeated").alias("n_repeated"), F.coalesce("repeated_spans", F.lit("")).alias("repeated_spans"), F.coalesce("earlier_ids", F.array().cast("array<bigint>")).alias("earlier_ids"),
        zero("n_first").alias("n_first"), F.coalesce("first_spans", F.lit("")).alias("first_spans"),
        (zero("up") + zero("down")).alias("n_links"), F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"),
    )


def without_words(text: str, spans: str) -> str:
    """``text`` without the words of the spans and the white space after each."""
    import re

    words = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    out, at = [], 0
    for s, e in (map(int, x.split(":")) for x in spans.split(",") if x):
        out.append(text[at : words[s][0]])
        at = words[e][0] if e < len(words) else len(text)
    return "".join([*out, text[at:]])
