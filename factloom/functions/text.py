"""Text functions as columns.

Lower-casing and word signs follow Unicode.  The two set similarities differ on empty input:
``multiset_jaccard`` and ``char_jaccard`` give 1 for two empty texts, ``lexical_overlap`` gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: str | Column) -> Column:
    """Lower-case runs of word signs, repeats kept."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(?U)\w+"), F.lit(0))


def word_set(text: str | Column) -> Column:
    return F.array_distinct(words(text))


def stripped(text: str | Column) -> Column:
    """Without white space (Unicode's) at the ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def squeezed(text: str | Column) -> Column:
    """White space runs become one space; none at the ends; case is kept."""
    return stripped(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once: a lambda's body is computed again for each element, with all that it holds."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numbered(xs: Column) -> Column:
    """Each word with the number of its occurrence, so that multisets are sets; by sorting, not by counting each word in the whole text."""
    new = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, starts: lambda at, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(starts, j + 1), F.size(s)) - at), lambda k: F.concat_ws(" ", F.get(s, at), k.cast("string")))
    every = lambda s: _bound(new(s), lambda starts: F.flatten(F.transform(starts, run(s, starts))))
    return _bound(F.array_sort(xs), lambda s: F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(every(s)))


def multiset_jaccard(short: str | Column, long: str | Column) -> Column:
    """Sum of least counts over sum of greatest counts of words; the value is symmetric."""

    def value(p: Column) -> Column:
        shared = F.size(F.array_intersect(p["a"], p["b"]))
        total = F.size(p["a"]) + F.size(p["b"]) - shared
        return F.when(total == 0, F.lit(1.0)).otherwise(shared.cast("double") / total)

    return _bound(F.struct(_numbered(words(short)).alias("a"), _numbered(words(long)).alias("b")), value)


def lexical_overlap(left: str | Column, right: str | Column) -> Column:
    """Jaccard of word sets; 0 if either is empty."""
    a, b = word_set(left), word_set(right)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def char_jaccard(left: str | Column, right: str | Column) -> Column:
    """Jaccard of character sets, white space included; 1 if both are empty."""
    chars = lambda t: F.filter(F.array_distinct(F.split(t, "")), lambda x: x != "")
    a, b = chars(_c(left)), chars(_c(right))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / every)


def span_conciseness(evidence: str | Column, source: str | Column) -> Column:
    e, s = F.lower(_c(evidence)), F.lower(_c(source))
    return F.when((e == "") | (s == ""), F.lit(0.0)).otherwise(char_jaccard(e, s))


def edit_ratio(left: str | Column, right: str | Column) -> Column:
    """1 - edit distance / longer length, in code points; 1 for equal texts, empty ones too."""
    a, b = _c(left), _c(right)
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def best_window_ratio(needle: str | Column, hay: str | Column) -> Column:
    """Best edit ratio of ``needle`` with windows of three lengths of ``hay``: its own and a third less or more.

    A needle that occurs verbatim is 1 without a search.  Case is kept; an empty side gives 0.
    """
    a, b = _c(needle), _c(hay)
    n, size = F.length(a), F.length(b)
    off = F.greatest(F.lit(2), F.floor(n / 3).cast("int"))
    low = F.greatest(F.lit(1), n - off)
    sizes = F.filter(F.array_distinct(F.array(low, n, n + off)), lambda w: w <= size)
    windows = F.flatten(F.transform(sizes, lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda at: edit_ratio(a, F.substring(b, at, w)))))
    searched = F.when(low > size, edit_ratio(a, b)).otherwise(F.array_max(windows))
    return F.when((n == 0) | (size == 0), F.lit(0.0)).when(F.instr(b, a) > 0, F.lit(1.0)).otherwise(searched)


def surface_similarity(name: str | Column, text: str | Column) -> Column:
    """Lower-cased: 1 if contained, else the best window; 0 if either is empty."""
    return best_window_ratio(F.lower(_c(name)), F.lower(_c(text)))


def name_match(name: str | Column, evidence: str | Column) -> Column:
    """1 if the stripped name is contained, else its edit ratio with the whole evidence; 0 if either is empty."""
    n, e = F.lower(stripped(name)), F.lower(_c(evidence))
    return F.when((n == "") | (e == ""), F.lit(0.0)).when(F.instr(e, n) > 0, F.lit(1.0)).otherwise(edit_ratio(n, e))


def looks_like_predicate(name: str | Column) -> Column:
    return stripped(name).rlike(r"^[a-z]\w*$")


def unfenced(reply: str | Column) -> Column:
    """A model's reply without a Markdown code fence around it."""
    t = stripped(reply)
    inner = F.regexp_replace(F.regexp_replace(t, r"^`+(?i:json)?", ""), r"`+$", "")
    return F.when(t.startswith("```"), stripped(inner)).otherwise(t)


def lead_summary(names: str | Column, evidence: str | Column, most: int = 280) -> Column:
    """Distinct names joined by commas, then the first evidence that isn't blank; each part and the whole cut to ``most``."""
    head = F.substring(F.array_join(F.array_distinct(F.filter(_c(names), lambda x: F.coalesce(x, F.lit("")) != "")), ", "), 1, most)
    full = F.filter(F.transform(_c(evidence), lambda x: stripped(F.coalesce(x, F.lit("")))), lambda x: x != "")
    tail = F.substring(F.get(full, F.lit(0)), 1, most)
    return F.when(F.size(full) > 0, F.substring(F.concat(head, F.lit(". "), tail), 1, most)).otherwise(head)
