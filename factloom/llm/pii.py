"""PII: base patterns, and terms that give protected values away.

Redacting an address is not enough if a rare name beside it occurs nowhere else.  Corpus
co-occurrence says how strongly a term t reveals a protected value e: with IC(e) = -log2 p(e) and
PMI(t, e) = log2(p(e | t) / p(e)), the share PMI / IC is 0 if t tells nothing about e and 1 if t
occurs only with e.  All probabilities are over documents.  Terms within ``Disclosure.window``
words of a value in any document are candidates, and then count in every document that holds both,
however far apart.  In documents that hold e, a candidate whose share reaches
``generalise`` is generalised (replaced by its kind), one that reaches ``remove`` is removed,
wherever in the text it stands.

Evidence has to be independent: copies of one document are one witness.  Each document carries a
min-hash of its five-word shingles, and every count (of documents with e, with t, with both, and in
all) is of different min-hashes.  A pair with ``support`` witnesses is judged by its share alone.
One with fewer, down to a value found in one document, also needs that the corpus is large
enough to show it: that many shared witnesses are expected by accident at most ``chance`` times.

Counts cover all documents.  How many witnesses hold a term is counted for candidates only: tasks
pass the words whose hash is set in a bitmap of fixed size, and the join that follows is exact.
Documents without a copy are their own witness and are counted in the tasks; a term that they
make too common is done with, and only for the others are the copies' min-hashes shuffled.

A null text is empty.  A null doc_id is an id like any other.  Rows with the same id are told apart by a row number, and each is
judged by its own text.  Where a term has verdicts from several values, removal wins.  Spans that start together are listed
by kind.  Whole texts are searched, however long.  Empty tables give no rows.  Extra columns, whatever their names, stay in
``sanitise`` and are left out of ``personal_data``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import pieces, rows_to_batch, sha256_hex, unused, with_unique_key
from factloom.llm.passages import WordCodes, kmers, word_codes
from factloom.plans.scratch import materialise

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")
# The lookbehind stands after the first digit so that the search can skip to digits.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")
MAP_BITS = 1 << 24
FLUSH = 200_000


@dataclass(frozen=True)
class Disclosure:
    window: int = 25
    support: int = 3
    chance: float = 0.01
    generalise: float = 0.75
    remove: float = 0.95
    min_chars: int = 3


def emails(text: str) -> list[tuple[int, int]]:
    """The spans of the leftmost-match search, found from each @ outwards in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1  # nothing before this @ can belong to a later match
        at = text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping per kind."""
    out = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), 42)


def witness(text: str, codes: WordCodes) -> int:
    """A min-hash of five-word shingles: documents that are copies of each other mostly share it."""
    words = word_codes(text.encode(), codes)
    shingles = kmers(words)
    least = int(shingles.min()) if len(shingles) else xxhash.xxh64_intdigest(words.tobytes(), 7)
    return least & (2**63 - 1)


def term_places(text: str, base: list[tuple[int, int, int]], rule: Disclosure) -> tuple[np.ndarray, list[str], dict[str, list[tuple[int, int]]]]:
    """The starts of all words, the words, and term -> all its spans in the text; words inside base spans are no terms."""
    words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
    starts = np.array([w[0] for w in words], np.int64)
    inside = np.zeros(len(words), bool)
    for a, _, z in base:
        inside[np.searchsorted(starts, a) : np.searchsorted(starts, z)] = True
    places: dict[str, list[tuple[int, int]]] = {}
    for i, (a, z, w) in enumerate(words):
        if not inside[i] and len(w) >= rule.min_chars:
            places.setdefault(w, []).append((a, z))
    return starts, [w[2] for w in words], places


def value_number(text: str, a: int, k: int, z: int) -> int:
    return term_hash(f"{KINDS[k]}:{text[a:z].lower()}") - 2**63


def revealing_candidates(text: str, base: list[tuple[int, int, int]], rule: Disclosure) -> dict[int, set[str]]:
    """protected value -> terms near it."""
    starts, words, places = term_places(text, base, rule)
    out: dict[int, set[str]] = {}
    for a, k, z in base:
        lo, hi = int(np.searchsorted(starts, a)), int(np.searchsorted(starts, z))
        near = set(words[max(0, lo - rule.window) : hi + rule.window])
        out.setdefault(value_number(text, a, k, z), set()).update(near & places.keys())
    return out


FOUND = pa.schema([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base", pa.string()), ("value", pa.int64()), ("term", pa.string()), ("witness", pa.int64())])
FOUND_SQL = "n_email long, n_ip long, n_card long, n_phone long, base string, value long, term string, witness long"


def scan(docs: DataFrame, rule: Disclosure) -> DataFrame:
    """A row of results for each document (value null), one for each value in it (term null), and one for each candidate (value, term) that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in pieces(batches):
            rows, at = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                base, sketch = base_spans(text or ""), witness(text or "", codes)
                counts = [0] * 4
                for _, k, _ in base:
                    counts[k] += 1
                rows.append((*counts, listed(base), None, None, sketch))
                at.append(i)
                if base:
                    for value, terms in revealing_candidates(text, base, rule).items():
                        for term in (None, *terms):
                            rows.append((0, 0, 0, 0, None, value, term, sketch))
                            at.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *rows_to_batch(rows, FOUND).columns], ["doc_id", *FOUND.names])

    near = materialise(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND_SQL}"), "pii")
    return near.filter(F.col("term").isNull()).unionByName(materialise(held(docs, near, rule), "held"))


def held(docs: DataFrame, near: DataFrame, rule: Disclosure) -> DataFrame:
    """A row for each document and candidate (value, term) in it, with all spans of the term, near the value or not.

    A bitmap says which documents hold values, another which pairs are candidates; the join that follows is exact.
    """
    wanted = near.filter(F.col("term").isNotNull()).select("value", "term").distinct()
    number = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    pairs = bitmap(wanted, F.pmod(F.col("value").bitwiseXOR(F.xxhash64("term")), F.lit(MAP_BITS)))
    shared = docs.sparkSession.sparkContext.broadcast((pairs, bitmap(near.filter(F.col("value").isNotNull()), number)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, ids), codes = shared.value, WordCodes()
        for b in pieces(batches):
            numbers = b.column(2).to_numpy()
            for i in np.flatnonzero(ids[numbers >> 3] >> (numbers & 7).astype(np.uint8) & 1).tolist():
                text = b.column(1)[i].as_py() or ""
                base = base_spans(text)
                if not base:
                    continue
                sketch, places = witness(text, codes), term_places(text, base, rule)[2]
                terms = list(places)
                hashes = np.array([term_hash(w) % MAP_BITS for w in terms], np.int64)
                spans = [",".join(f"{a}:{z}" for a, z in places[w]) for w in terms]
                for value in {value_number(text, *span) for span in base}:
                    h = hashes ^ value % MAP_BITS
                    rows = [(0, 0, 0, 0, spans[j], value, terms[j], sketch) for j in np.flatnonzero(bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).tolist()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows), pa.int64())), *rows_to_batch(rows, FOUND).columns], ["doc_id", *FOUND.names])

    rows = docs.select("doc_id", "text", number.alias("bit")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND_SQL}")
    return rows.join(wanted, ["value", "term"], "left_semi").select("doc_id", *FOUND.names)


def bitmap(keys: DataFrame, bit: Column) -> np.ndarray:
    """MAP_BITS bits, packed, with those of ``keys`` set."""
    parts = keys.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("long")).alias("bits"))
    mask = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.collect():  # at most MAP_BITS / 32768 rows of 4 KB
        mask[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return mask


def term_witnesses(docs: DataFrame, wanted: DataFrame, copied: np.ndarray, copies: bool, rule: Disclosure) -> DataFrame:
    """term, n: how many witnesses hold each wanted term, among documents in the bitmap ``copied`` (by id) or among all others.

    The others have a witness each, and their counts are summed in the tasks first.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    shared, least = docs.sparkSession.sparkContext.broadcast((bitmap(wanted, bit("term")), copied)), rule.min_chars
    names = pa.schema([("term", pa.string()), ("witness", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (terms, ids), counts, known, codes = shared.value, Counter(), {}, WordCodes()
        for b in pieces(batches):
            number = b.column(1).to_numpy()
            for i in np.flatnonzero((ids[number >> 3] >> (number & 7).astype(np.uint8) & 1).astype(bool) == copies).tolist():
                text = b.column(0)[i].as_py()
                if not text:
                    continue
                sketch = witness(text, codes) if copies else None
                for w in {w.lower() for w in set(WORD.findall(text))}:
                    hit = known.get(w)
                    if hit is None:
                        h = term_hash(w) % MAP_BITS
                        hit = known[w] = bool(len(w) >= least and terms[h >> 3] >> (h & 7) & 1)
                    if hit:
                        counts[w, sketch] += 1
            if len(known) > FLUSH:
                known.clear()
            if len(counts) > FLUSH:
                yield rows_to_batch([(*k, n) for k, n in counts.items()], names)
                counts.clear()
        yield rows_to_batch([(*k, n) for k, n in counts.items()], names)

    rows = docs.select("text", bit("doc_id").alias("bit")).mapInArrow(run, "term string, witness long, n long")
    if copies:
        rows = rows.groupBy("term", "witness").agg(F.lit(1).alias("n"))
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(docs: DataFrame, found: DataFrame, rule: Disclosure) -> DataFrame:
    """value, term, share (of the value's information that the term gives away), action."""
    pairs, every = found.filter(F.col("value").isNotNull()), found.filter(F.col("value").isNull())
    joint = materialise(pairs.filter(F.col("term").isNotNull()).select("value", "term", "witness").distinct().groupBy("value", "term").agg(F.count("*").alias("n_both")), "joint")
    values = pairs.select("value", "witness").distinct().groupBy("value").agg(F.count("*").alias("n_value"))
    sizes = every.groupBy("witness").agg(F.count("*").alias("size"))
    total = max(1, sizes.count())
    several = every.join(sizes.filter("size > 1"), "witness", "left_semi")
    copied = bitmap(several, F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)))

    def judged(rows: DataFrame) -> DataFrame:
        """Rows whose share and chance reach the limits; both only get worse with a larger n."""
        n, accident = F.greatest("n", "n_both"), F.lit(1.0)
        information = F.log2(F.lit(float(total)) / F.col("n_value"))
        share = F.when(information > 0, F.log2(F.col("n_both") / n * total / F.col("n_value")) / information).otherwise(F.lit(0.0))
        for i in range(rule.support - 1):  # the expected number of sets of n_both witnesses that both have
            accident *= F.when(F.col("n_both") > i, (n - i) * (F.col("n_value") - i) / float(max(1, total - i) * (i + 1))).otherwise(F.lit(1.0))
        return rows.withColumn("share", share).filter((F.col("share") >= rule.generalise) & ((F.col("n_both") >= rule.support) | (accident <= rule.chance)))

    single = term_witnesses(docs, joint.select("term"), copied, False, rule)
    rows = joint.join(values, "value").join(single, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    left = materialise(judged(rows).drop("share"), "judged")
    more = term_witnesses(docs, left.select("term"), copied, True, rule).withColumnRenamed("n", "more")
    rows = judged(left.join(more, "term", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))))
    action = F.when(F.col("share") >= rule.remove, "remove").otherwise("generalise")
    return rows.select("value", "term", "share", action.alias("action"))


def personal_data(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, removed (the spans of terms to remove), n_personal (base spans)."""
    rows, key = with_unique_key(docs)
    found = data_of_rows(rows.select(F.col(key).alias("doc_id"), "text"), rule)
    if key == "doc_id":
        return found
    ids = rows.select(F.col(key).alias("number"), F.col("doc_id").alias("id"))
    return found.join(ids, F.col("doc_id") == F.col("number")).select(F.col("id").alias("doc_id"), *found.columns[1:])


def data_of_rows(docs: DataFrame, rule: Disclosure) -> DataFrame:
    """The same, for different ids."""
    found = scan(docs, rule)
    told = materialise(disclosures(docs, found, rule), "disclosures")
    terms = found.filter(F.col("term").isNotNull()).join(told, ["value", "term"])
    # One row a document and term, the stronger action first; then a bounded list a document (its own spans).
    per_term = terms.groupBy("doc_id", "term").agg(F.max("action").alias("action"), F.first("base").alias("spans"))
    per_doc = per_term.groupBy("doc_id").agg(F.collect_list(F.struct("spans", "action")).alias("terms")).withColumnRenamed("doc_id", "id")
    base = found.filter(F.col("value").isNull()).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base")
    rows = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")
    id_type = docs.schema["doc_id"].dataType
    names = pa.schema([("base_sha256", pa.string()), ("spans", pa.string()), ("n_term", pa.int64()), ("removed", pa.string()), ("n_personal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, terms in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                spans = [(int(a), KINDS.index(k), int(z)) for k, a, z in (x.split(":") for x in base.split(",") if x)]
                own = sorted((int(a), 4, int(z), t["action"]) for t in terms or () for a, z in (x.split(":") for x in t["spans"].split(",")))
                gone = [x[:3] for x in own if x[3] == "remove"]
                out.append((sha256_hex(base), listed(spans + [x[:3] for x in own]), len(own), listed(gone), len(spans)))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *rows_to_batch(out, names).columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", *names.names])

    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, removed string, n_personal long")


def parse(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in spans.split(",") if x)]


def sanitised(text: str, spans: str, removed: str = "") -> str:
    """``text`` with base spans replaced by their kind, terms generalised to a kind of word, and removed terms left out."""
    gone, out, at = set(parse(removed)), [], 0
    for kind, a, z in sorted(parse(spans), key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, z)
            continue
        out.append(text[at:a])
        word = text[a:z]
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif (kind, a, z) not in gone:
            out.append("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]")
        at = z
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with text sanitised, a row for a row."""
    rows, key = with_unique_key(docs)
    own, spans, removed = unused(rows.columns, "id", "spans", "removed")
    found = data_of_rows(rows.select(F.col(key).alias("doc_id"), "text"), rule).select(F.col("doc_id").alias(own), F.col("spans").alias(spans), F.col("removed").alias(removed))
    columns = [rows[f"`{c}`"] for c in docs.columns]
    rows = rows.join(found, rows[key].eqNullSafe(found[own]), "left").select(*columns, spans, removed)
    at, n, names = docs.columns.index("text"), len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [t and sanitised(t, s or "", r or "") for t, s, r in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            columns = list(b.columns[:n])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)
