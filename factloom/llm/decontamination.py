"""Benchmark decontamination with suffix arrays over the training shards.

Each task sorts the suffixes of its shard of documents and matches them with the sorted benchmark windows by
binary search of the shorter side in the longer, which gives all places of every benchmark window.  The array is
sparse: a suffix that does not start with a run of benchmark word pairs as long as the shortest window cannot hold
one, and is left out before sorting, so nothing is lost.  From each place found, the longest verbatim match comes from a
binary search among the benchmark's own suffixes.

A window counts once, however many items have it: a hit is a place and a window, windows with the same items share one list of
them, and lists are read once per document.  So a text that many items share costs its occurrences, not occurrences times items.

The benchmark goes to the tasks in slices of at most ``SLICE_BYTES`` of text, as arrays of some 80 bytes a word and a dictionary of
its different words.  One slice, the usual case, is one narrow pass over the documents; with more slices each makes a
pass and what they found is merged by document.

Null or wordless texts have no words and no hits; null or wordless items match nothing.  An item
listed twice counts once; a null item id counts as an item with an empty name.  Repeated documents, null ids among them,
are each judged.  Of equally long matches at a place the first in the order of suffixes counts.  Very long texts are a shard of their own.
Empty tables: no documents, or nobody hit.  Extra columns, whatever their names, are kept by ``remove_contaminated`` and left out else.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import pieces, rows_to_batch
from factloom.plans.scratch import materialise

WINDOW, SLICE_BYTES, SHARD_BYTES = 10, 12 << 20, 8 << 20
#: Everything but 0-9, a-z and bytes from 0x80 parts words; A-Z are lower-cased first.
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Places of ``words`` (0 ends an item) in the order of the suffixes that start there, by doubling prefixes."""
    n, step = len(words), 1
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, np.int64)
    live = words > 0  # of an item's end nothing more is compared
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        after[~live] = 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = (key[order[1:]] != key[order[:-1]]).cumsum()
        live[: n - step] &= live[step:]  # suffixes with an end among the first 2 * step words
        live[n - step :] = False
        if not live.any() or (len(new) and new.max() == n - 1):
            return order.astype(np.int32)
        rank, step = new, 2 * step


class TestSuffixes:
    """The windows of a slice of the benchmark, as words by number, and its suffixes in order."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        #: Numbers go with the order of names.
        self.names = sorted({name for name, _ in items})
        number, parts, owner = {name: i for i, name in enumerate(self.names)}, [], []
        for name, text in sorted(set(items)):
            words = split_words(text)
            if words:
                parts += [np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in words), np.int32, len(words)), np.zeros(1, np.int32)]
                owner.append((number[name], len(words)))
        self.words = words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lengths = np.array([n for _, n in owner], np.int64)
        self.first = np.concatenate([[0], (lengths + 1).cumsum()])  # where items start in words
        self.owner = np.array([i for i, _ in owner], np.int32)
        self.base = len(self.ids) + 1
        both = (words[:-1] > 0) & (words[1:] > 0)
        self.pairs = np.unique(words[:-1][both] * np.int64(self.base) + words[1:][both])
        self.mask = np.zeros(1 << 22, bool)
        self.mask[(self.pairs * 0x9E3779B1 >> 9) & ((1 << 22) - 1)] = True
        self.window, self.shortest = window, int(lengths.min(initial=window))
        self.order, self.raw = suffix_order(words), words.astype(">u4").tobytes()
        #: size -> (sorted windows of so many words, the list of items of each)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.short: dict[bytes, int] = {}
        lists: list[np.ndarray] = []
        for size in sorted(set(np.minimum(lengths, window).tolist())):
            own = np.flatnonzero(lengths == size if size < window else lengths >= size)
            many = lengths[own] - size + 1
            item = np.repeat(own, many)
            place = np.arange(len(item)) - np.repeat(many.cumsum() - many, many) + self.first[item]
            keys, group = np.unique(window_keys(words, place, size), return_inverse=True)
            if size < window:  # where the first of the items that are these words stands
                for i in self.first[own].tolist():
                    self.short.setdefault(self.raw[4 * i : 4 * (i + size)], i)
            pairs = np.unique(group.astype(np.int64) << 32 | self.owner[item])
            lists.append(pairs)
            self.windows[size] = keys, np.zeros(len(keys), np.int32)
        self.lists = self._item_lists(lists)

    def _item_lists(self, pairs: list[np.ndarray]) -> list[np.ndarray]:
        """Different lists of items; each window gets the number of its own."""
        known: dict[bytes, int] = {}
        out: list[np.ndarray] = []
        for (_, list_of), own in zip(self.windows.values(), pairs, strict=True):
            items = (own & 0xFFFFFFFF).astype(np.int32)
            ends = np.searchsorted(own >> 32, np.arange(len(list_of)), "right")
            starts = np.concatenate([[0], ends[:-1]])
            single = ends - starts == 1
            first_of = np.full(len(self.names), -1, np.int32)  # the list of one item alone
            for i in np.unique(items[starts[single]]).tolist():
                first_of[i] = known.setdefault(np.int32(i).tobytes(), len(out))
                if first_of[i] == len(out):
                    out.append(np.array([i], np.int32))
            list_of[single] = first_of[items[starts[single]]]
            for w in np.flatnonzero(~single).tolist():
                own_items = items[starts[w] : ends[w]]
                at = known.setdefault(own_items.tobytes(), len(out))
                if at == len(out):
                    out.append(own_items)
                list_of[w] = at
        return out

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Places where a window may begin: a run of at least shortest - 1 known pairs, or a lone word that is an item."""
        n = len(codes)
        if not n or not self.windows:
            return np.zeros(0, np.int64)
        if self.shortest == 1:
            ok = codes > 0
        else:
            ok, key = np.zeros(n, bool), codes[:-1] * self.base + codes[1:]
            near = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            near = near[self.mask[(key[near] * 0x9E3779B1 >> 9) & ((1 << 22) - 1)]]
            at = np.searchsorted(self.pairs, key[near])
            near = near[self.pairs[np.minimum(at, len(self.pairs) - 1)] == key[near]]
            ok[near] = True
            need = self.shortest - 1
            total = np.concatenate([[0], ok.cumsum()])
            run = np.zeros(n, bool)
            run[: n - need + 1] = total[need:] - total[: n - need + 1] == need
            ok = run
        return np.flatnonzero(ok)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """place, words and list of items for each occurrence of a window in ``codes``, by place."""
        where, found = self.starts(codes), []
        for size, (keys, list_of) in self.windows.items():
            own = where[where + size <= len(codes)]
            suffixes = window_keys(codes, own, size)
            order = np.argsort(suffixes, kind="stable")  # the shard's suffix array, as far as windows go
            suffixes, own = suffixes[order], own[order]
            if len(suffixes) < len(keys):
                at = np.searchsorted(keys, suffixes)
                hit = keys[np.minimum(at, len(keys) - 1)] == suffixes
                at = at[hit]
            else:
                low, high = np.searchsorted(suffixes, keys), np.searchsorted(suffixes, keys, "right")
                hit = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat((high - low).cumsum() - (high - low), high - low)
                at = np.repeat(np.arange(len(keys)), high - low)
            found.append(np.stack([own[hit], np.full(len(at), size), list_of[at]]))
        place, words, lists = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.lexsort((words, place))
        return place[order], words[order], lists[order]

    def longest_at(self, codes: np.ndarray, place: int) -> tuple[int, int]:
        """The most words from ``place`` that follow each other in an item, and where in ``words``: the first such suffix in order."""
        limit, raw, order = 64, self.raw, self.order
        while True:
            part = codes[place : place + limit]
            unknown = np.flatnonzero(part == 0)
            part = part[: unknown[0]] if len(unknown) else part
            target = part.astype(">u4").tobytes()
            size, best = len(target), 0
            at = bisect_left(order, target, key=lambda q: raw[4 * q : 4 * q + size])
            for i in (at - 1, at):
                if 0 <= i < len(order):
                    own = np.frombuffer(raw[4 * order[i] : 4 * order[i] + size], ">u4")
                    other = np.flatnonzero(own != part[: len(own)])
                    best = max(best, int(other[0]) if len(other) else len(own))
            if best < limit:
                break
            limit *= 4
        target = target[: 4 * best]
        return best, int(order[bisect_left(order, target, key=lambda q: raw[4 * q : 4 * q + len(target)])])


def window_keys(words: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """``size`` words from each place as one value that sorts like them."""
    if not len(places):
        return np.zeros(0, f"S{4 * size}")
    return np.lib.stride_tricks.sliding_window_view(words.astype(">u4"), size)[places].view(f"S{4 * size}").reshape(-1)


class Hits:
    """What a shard's documents share with the benchmark."""

    def __init__(self, texts: list[bytes | None], tests: TestSuffixes):
        parts, counts, get = [], [], tests.ids.get
        for text in texts:
            words = split_words(text)
            counts.append(len(words))
            parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
        self.tests, self.counts = tests, counts
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], (np.array(counts, np.int64) + 1).cumsum()]).astype(np.int64)
        self.place, self.words, self.lists = tests.find(self.codes)
        self.ends = np.searchsorted(self.place, self.first)

    def documents(self) -> np.ndarray:
        """Which documents are hit."""
        return np.flatnonzero(np.diff(self.ends))

    def windows(self, doc: int) -> list[tuple[int, int]]:
        """(start, words) of the windows in a document, joined where they overlap or touch."""
        a, z = self.ends[doc], self.ends[doc + 1]
        out: list[list[int]] = []
        for start, size in zip((self.place[a:z] - self.first[doc]).tolist(), self.words[a:z].tolist()):
            if out and start <= out[-1][0] + out[-1][1]:
                out[-1][1] = max(out[-1][1], start + size - out[-1][0])
            else:
                out.append([start, size])
        return [(s, n) for s, n in out]

    def items(self, doc: int) -> list[str]:
        """Names of the items with windows in a document, in order."""
        lists = [self.tests.lists[i] for i in np.unique(self.lists[self.ends[doc] : self.ends[doc + 1]]).tolist()]
        return [self.tests.names[i] for i in np.unique(np.concatenate(lists)).tolist()] if lists else []

    def longest(self, doc: int) -> list[tuple[int, int, str, int]]:
        """(start, words, item, start in the item) of the verbatim matches that no other match of the document contains."""
        tests, first = self.tests, int(self.first[doc])
        a, z = int(self.ends[doc]), int(self.ends[doc + 1])
        size_at = dict(zip(self.place[a:z].tolist(), self.words[a:z].tolist()))  # the largest window of each place
        out, reached, window = [], 0, tests.window
        for place, size in size_at.items():
            # A longer match from here on would hold the whole window that ends just beyond ``reached``.
            if place + size <= reached and (size < window or size_at.get(reached - window + 1) != window):
                continue
            if size < window:
                words, q = size, tests.short[self.codes[place : place + size].astype(">u4").tobytes()]
            else:
                words, q = tests.longest_at(self.codes, place)
            if place + words > reached:
                item = int(np.searchsorted(tests.first, q, "right")) - 1
                out.append((place - first, words, tests.names[tests.owner[item]], q - int(tests.first[item])))
                reached = place + words
        return out


def covered_words(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for start, size in sorted(spans):
        total += max(0, start + size - max(start, end))
        end = max(end, start + size)
    return total


def shards(batches: Iterator[pa.RecordBatch], at_text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a partition of about SHARD_BYTES of text (one document may be larger)."""
    for b in pieces(batches, 4096):
        texts, at, size = b.column(at_text).cast(pa.binary()).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size >= SHARD_BYTES or i == len(texts) - 1:
                yield b.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def benchmark_slices(benchmark: DataFrame, limit: int = SLICE_BYTES) -> list[list[tuple[str, bytes]]]:
    """Each within ``limit`` bytes (a single longer item makes its own slice); its size is checked before it is read."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + 2 * (total // limit)
    if n == 1:
        return [[(r["name"], bytes(r["text"])) for r in items.collect()]]
    kept = materialise(items.withColumn("slice", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")), "benchmark")
    return [[(r["name"], bytes(r["text"])) for r in kept.filter(F.col("slice") == i).collect()] for i in range(n)]


def matches(docs: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, n_words, spans (start, words: the windows, joined), items (those with windows) and matches (start, words, item_id,
    item_start: the longest verbatim ones) of each document.
    """
    id_type = docs.schema["doc_id"].dataType
    tests = docs.sparkSession.sparkContext.broadcast(TestSuffixes(items))
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
    match = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))

    def structs(rows: dict[int, list[tuple]], n: int, kind: pa.DataType) -> pa.Array:
        names = [f.name for f in kind.value_type]
        return pa.array([[dict(zip(names, x)) for x in rows.get(i, ())] for i in range(n)], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in shards(batches, 1):
            hits, n = Hits(texts, tests.value), len(texts)
            hit = hits.documents().tolist()
            spans, longest = structs({i: hits.windows(i) for i in hit}, n, span), structs({i: hits.longest(i) for i in hit}, n, match)
            found = {i: hits.items(i) for i in hit}
            items = pa.array([found.get(i, []) for i in range(n)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits.counts, pa.int64()), spans, items, longest], ["doc_id", "n_words", "spans", "items", "matches"])

    columns = "n_words long, spans array<struct<start:long,words:long>>, items array<string>, matches array<struct<start:long,words:long,item_id:string,item_start:long>>"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, {columns}")


def contamination(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words)."""
    slices = benchmark_slices(benchmark, slice_bytes)
    if len(slices) == 1:
        found = matches(docs, slices[0])
    else:  # rows are told apart by a number, as ids may repeat
        numbered = materialise(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("id"), "text"), "numbered")
        every = None
        for items in slices:
            part = matches(numbered, items)
            every = part if every is None else every.unionByName(part)
        merged = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")))
        found = merged.join(numbered.select("doc_id", "id"), "doc_id").select(F.col("id").alias("doc_id"), "n_words", "spans", "items", "matches")
    id_type = found.schema["doc_id"].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64())])
        for b in batches:
            rows = []
            for spans, items, most in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                own = sorted(set(items))
                hit = covered_words([(m["start"], m["words"]) for m in spans])
                rows.append((hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0, most))
            more = rows_to_batch(rows, names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more.columns], ["doc_id", "n_words", *names.names])

    rows = found.select("doc_id", "n_words", "spans", "items", F.coalesce(F.array_max("matches.words"), F.lit(0)).alias("most"))
    return rows.mapInArrow(digest, f"doc_id {id_type.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; no shuffle, one filter per slice."""
    out, at = docs, docs.columns.index("text")
    for items in benchmark_slices(benchmark, slice_bytes):
        tests = docs.sparkSession.sparkContext.broadcast(TestSuffixes(items))

        def clean(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for b, texts in shards(batches, at):
                hits = Hits(texts, tests.value)
                yield b.filter(pa.array(np.diff(hits.ends) == 0))

        out = out.mapInArrow(clean, docs.schema)
    return out
