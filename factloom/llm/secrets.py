"""Secret scanning by sliding-window Shannon entropy.

Candidates are runs of 20 or more token characters.  A window slides over each; per-character counts, and
with them the sum of c log c, are updated for the character that enters and the one that leaves.  A
candidate is a secret if a window reaches the threshold of the candidate's character class and no allow-list
pattern suppresses it.  Digits only, and letters of one case only, are no class: numbers and words look like that.

With these thresholds 0.92 to 1.00 of random strings of 20 to 40 characters are found in each class, and at most 0.02 of
identifiers, paths and slugs made of words are taken for secrets (tests/llm/test_secrets.py measures both).

Base patterns always count, allow-listed or not.  A null text is empty.  Each row stands alone, so repeated rows,
ties, extra columns (left out, whatever their names) and empty tables need no case of their own.  Whole texts are scanned in
linear time, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import pieces, rows_to_batch, sha256_hex

KINDS = ("assign", "access", "hex", "entropy")
# ASCII: the keyword's letters match in either case, but not their Unicode look-alikes.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.ASCII)
KEYWORD_ENDS = re.compile(r"(?i)password|passwd|secret|token|api_?key", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
# A run of 16 or more; shorter runs would be dropped, and none is retried within.
HEX = re.compile(r"[0-9a-f]{16,}+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
WINDOW = 20
HEX_CHARS, WORD_CHARS = frozenset("0123456789abcdefABCDEF"), frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
C_LOG_C = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUID
    r"(?i).*(example|sample|placeholder|dummy|changeme|xxxx).*",
    r"(?i).*(abcdefghij|0123456789|1234567890|qwertyuiop).*",
    r"[0-9_=/+-]+",  # numbers and rulers
    # Words (of small letters, capitalised or all capitals), run together or with separators, and numbers at their ends.
    r"[/_=+-]*+(?:(?:[A-Z]?[a-z]{2,}+|(?:Of|To|In|On|By|Is|At|As|An|Or|If|No|Id|Up|Do|It)|[A-Z]{2,}+|[a-zA-Z](?=[0-9]{0,4}(?:[/_=+-]|$)))++[0-9]{0,4}+(?:[/_=+-]++|$)|[0-9]{1,8}+(?:[/_=+-]++|$))++",
)


@dataclass(frozen=True)
class Thresholds:
    """Bits a character that a window must reach; log2(window) is the most possible."""

    hexadecimal: float = 3.0
    one_case: float = 3.5
    letters_digits: float = 3.6
    letters: float = 3.5
    base64: float = 3.65

    def of(self, token: str) -> float | None:
        """None: the class can't be told from words or numbers."""
        chars = set(token)
        digits = any("0" <= c <= "9" for c in chars)
        small, large = any("a" <= c <= "z" for c in chars), any("A" <= c <= "Z" for c in chars)
        if small + large + digits < 2:
            return None
        if chars <= HEX_CHARS and digits:
            return self.hexadecimal
        if not chars <= WORD_CHARS:
            return self.base64
        return self.letters if not digits else self.letters_digits if small and large else self.one_case


def window_entropies(token: str, window: int = WINDOW) -> Iterator[float]:
    """Entropy in bits of each window, by incremental counts; of the whole token if it is shorter."""
    n = min(window, len(token))
    table = C_LOG_C if n <= WINDOW else [0.0, *(c * math.log2(c) for c in range(1, n + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(token):
        k = counts.get(c, 0)
        total += table[k + 1] - table[k] if i < n else 0.0
        if i < n:
            counts[c] = k + 1
        else:
            old = token[i - n]
            k = counts[old]
            total += table[k - 1] - table[k]
            counts[old] = k - 1
            k = counts.get(c, 0)
            total += table[k + 1] - table[k]
            counts[c] = k + 1
        if i >= n - 1:
            yield math.log2(n) - total / n


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if KEYWORD_ENDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out


def entropy_spans(text: str, thresholds: Thresholds, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        least = thresholds.of(m[0])
        if least is not None and not allowed.fullmatch(m[0]) and any(h >= least - 1e-9 for h in window_entropies(m[0])):
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in sorted(spans))


def allow_list(patterns: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns) or "(?!)")


def scan(docs: DataFrame, thresholds: Thresholds = Thresholds(), allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, n_secrets (different spans, of any kind)."""
    allowed = allow_list(allow)
    id_type = docs.schema["doc_id"].dataType
    names = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64()), ("n_secrets", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = entropy_spans(text or "", thresholds, allowed)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, sha256_hex(listed(base)), listed(base + more), len(more), len({(a, z) for a, _, z in base + more})))
            yield pa.RecordBatch.from_arrays([b.column(0), *rows_to_batch(rows, names).columns], ["doc_id", *names.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, n_secrets long")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the union of the spans replaced."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
