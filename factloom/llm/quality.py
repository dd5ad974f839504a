"""Quality rules with risk-controlled cutoffs.

Base rules are fixed.  The method rejects by one score a document: how much more often bad than good
documents go as far in a rule (symbols, repeated lines, repeated words, capitals), as a log ratio, for
the rule that speaks most against it.  A quarter of the labelled texts gives these ratios.  On the other
three quarters, for each stratum (language), cutoffs of the score are tested from lenient to strict: a
cutoff passes if the exact binomial (Clopper-Pearson) bound on its rate of false rejection is below
``Risk.risk``.  Testing in a fixed order stops at the first failure and needs no further correction
within a stratum; the error level is divided by the number of strata (Bonferroni).  So with confidence
1 - delta no stratum loses more than ``risk`` of its good texts to the method.  All that pass are
guaranteed at once, so any data may choose among them: the one that rejects most bad texts, good
ones counting ``false_cost`` times.

Equal texts are one labelled text, so that copies don't count as independent evidence; near copies
do.  If labels of a text differ, the worst counts.  Null texts have no words and fail the base
rules.  A null language is a stratum of its own.  Documents without labels are judged, not used; null
ids have no labels.  Documents with equal scores are judged alike.  Strata without enough labels
(about 86 held-out good texts for four strata) get no cutoff and reject nothing.  Whole texts are read,
however long.  Repeated rows are judged each.  Empty tables give no rows.  Extra columns stay in
``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from factloom.llm.common import pieces, unused
from factloom.plans.scratch import broadcast_below, materialise

RULES, LEVELS = ("symbol", "dup_line", "repeat", "shout"), 256
#: A statistic of this much or more has the top level.
SCALES = (0.5, 1.0, 1.0, 1.0)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WORDS, WHITE = re.compile("[^\x20\x09-\x0d]+"), "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
COUNTS, LEVEL_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), tuple(f"{r}_level" for r in RULES)
#: One labelled text in PARTS trains the scores, the others are held out; SCALE steps of the score are a factor of e.
PARTS, SCALE = 4, 16
#: Strata whose cutoffs may be broadcast (under 1 MB); a merge join beyond.
STRATA = 10_000


@dataclass(frozen=True)
class Risk:
    """risk: largest share of a stratum's good texts that the method may reject."""

    risk: float = 0.05
    delta: float = 0.05
    false_cost: float = 20.0


@dataclass(frozen=True)
class Cutoffs:
    """scores[rule][level], the same for all strata; frame: s (a stratum) and the score from which it rejects."""

    scores: list[list[int]]
    frame: DataFrame

    def score(self, levels: list[str]) -> Column:
        """The greatest score of the rules, from their level columns."""
        return F.greatest(*(F.element_at(F.array(*map(F.lit, own)), F.col(c) + 1) for own, c in zip(self.scores, levels, strict=True)))


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    if len(ids) < 2_000_000:
        windows = (codes[:-2] * len(ids) + codes[1:-1]) * len(ids) + codes[2:]
    else:  # the product would overflow: number the pairs first
        pairs = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(n, bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def features(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then a level for each rule."""
    text = text or ""
    words = WORDS.findall(text)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars, symbols = sum(map(len, words)), sum(map(text.count, SYMBOLS))
    repeat = repeat_words(words)
    shout = sum(w.isupper() for w in words if len(w) > 1)
    shares = (symbols / max(1, chars), dup / max(1, lines), repeat / max(1, len(words)), shout / max(1, len(words)))
    levels = (min(LEVELS - 1, int(LEVELS * s / top)) for s, top in zip(shares, SCALES, strict=True))
    return len(words), chars, symbols, dup, repeat, *levels


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def content_number(text: str | None) -> int:
    """The same for equal texts."""
    return xxhash.xxh64_intdigest((text or "").encode(), 3) - 2**63


def with_features(docs: DataFrame, names: list[str], passing: bool = False) -> DataFrame:
    """``docs`` with columns called ``names``: the counts, the rules' levels, and a number of the content.

    ``passing``: without the documents that fail the base rules.
    """
    at, whole = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            found = np.array([(*features(t), content_number(t)) for t in texts], np.int64).reshape(b.num_rows, len(names))
            columns = [pa.array(found[:, i], pa.int32() if 5 <= i < 5 + len(RULES) else pa.int64()) for i in range(len(names))]
            out = pa.RecordBatch.from_arrays([*b.columns, *columns], [*whole, *names])
            yield out.filter(pa.array([not base_failed(int(f[0]), int(f[4])) for f in found], pa.bool_())) if passing else out

    schema = StructType(list(docs.schema.fields))
    for i, name in enumerate(names):
        schema = schema.add(name, IntegerType() if 5 <= i < 5 + len(RULES) else LongType())
    return docs.mapInArrow(run, schema)


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the counts and levels of every whole text, content."""
    rows = with_features(docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), "text"), [*COUNTS, *LEVEL_NAMES, "content"])
    return rows.drop("text")


def failed_column():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed in logarithms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def rule_scores(counts: np.ndarray) -> list[list[int]]:
    """counts[rule][good?][level] of the training texts -> scores[rule][level], never falling with the level.

    A level's score is the log of how much more often bad than good texts reach it (with half a text added to both).
    """
    reach = counts[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
    share = (reach + 0.5) / (reach[:, :, :1] + 1)
    ratio = np.log(share[:, 0]) - np.log(share[:, 1])
    ratio[:, 0] = 0
    return np.clip(np.rint(SCALE * np.maximum.accumulate(ratio, axis=1)), 0, LEVELS - 1).astype(int).tolist()


def choose_cutoff(counts: np.ndarray, limit: float, level: float, false_cost: float) -> int:
    """counts[held out?][good?][score] -> the score from which to reject, LEVELS for never."""
    above = counts[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # texts with this score or more
    n, best, value = int(above[1, 1, 0]), LEVELS, 0.0
    for cut in range(LEVELS - 1, 0, -1):
        k = int(above[1, 1, cut])
        if n == 0 or k > limit * n or binomial_tail(k, n, limit) > level:
            break
        gain = above[:, 0, cut].sum() - false_cost * above[:, 1, cut].sum()
        if gain > value:
            best, value = cut, gain
    return best


def labelled_texts(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, content, levels, good, held out?; a row per different labelled text that passes the base rules."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = feats.filter(~failed_column()).join(good, "doc_id").groupBy("stratum", "content").agg(F.min("good").alias("good"), *(F.max(c).alias(c) for c in LEVEL_NAMES))
    return rows.withColumn("held", F.pmod(F.shiftright("content", 5), F.lit(PARTS)) > 0)


def certified_cutoffs(feats: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> Cutoffs:
    """The rules' scores and each stratum's cutoff.

    Of the labelled texts, counts by rule and level (some thousands) reach the driver, and counts by score one task a stratum.
    """
    texts = materialise(labelled_texts(feats, labels), "labelled")
    counts = np.zeros((len(RULES), 2, LEVELS))
    rule = F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(c).alias("level")) for i, c in enumerate(LEVEL_NAMES)))).alias("x")
    for r in texts.filter(~F.col("held")).select("good", rule).groupBy("x.rule", "good", "x.level").count().collect():  # 2 x 256 rows a rule
        counts[r["rule"], int(r["good"]), r["level"]] = r["count"]
    found = Cutoffs(rule_scores(counts), texts)
    by_score = materialise(texts.groupBy("stratum", "held", "good", found.score(list(LEVEL_NAMES)).alias("score")).agg(F.count("*").alias("n")), "score-counts")
    strata = max(1, by_score.select("stratum").distinct().count())

    def calibrate(pdf):
        import pandas as pd  # here, as every worker that counts features would hold it otherwise

        grid = np.zeros((2, 2, LEVELS))
        np.add.at(grid, (pdf["held"].to_numpy(int), pdf["good"].to_numpy(int), pdf["score"].to_numpy(int)), pdf["n"].to_numpy(float))
        return pd.DataFrame({"s": [pdf["stratum"].iloc[0]], "cut": [choose_cutoff(grid, risk.risk, risk.delta / strata, risk.false_cost)]})

    return Cutoffs(found.scores, materialise(by_score.groupBy("stratum").applyInPandas(calibrate, "s string, cut int"), "cutoffs"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per document: doc_id, the base counts, levels, base_failed, kept, score, cut (the stratum's, 256 for none); each text is read once."""
    feats = materialise(document_features(docs), "features")
    cutoffs = certified_cutoffs(feats, labels, risk)
    rows = feats.join(broadcast_below(cutoffs.frame, STRATA), F.col("stratum").eqNullSafe(F.col("s")), "left")
    rows = rows.withColumn("score", cutoffs.score(list(LEVEL_NAMES))).withColumn("cut", F.coalesce("cut", F.lit(LEVELS))).withColumn("base_failed", failed_column())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.col("cut"))).drop("s", "stratum", "content")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The documents that the rules keep.

    Texts are read once: those that pass the base rules are written beside their levels and read again by the JVM for the verdict.
    """
    names = unused(docs.columns, *COUNTS, *LEVEL_NAMES, "content", "s", "cut")
    s, cut = names[-2:]
    rows = materialise(with_features(docs, names[:-2], passing=True), "passing")
    feats = rows.select("doc_id", F.col("lang").cast("string").alias("stratum"), *(F.col(f"`{n}`").alias(c) for n, c in zip(names, (*COUNTS, *LEVEL_NAMES, "content"))))
    cutoffs = certified_cutoffs(feats, labels, risk)
    frame = broadcast_below(cutoffs.frame.select(F.col("s").alias(s), F.col("cut").alias(cut)), STRATA)
    rows = rows.join(frame, rows["lang"].cast("string").eqNullSafe(frame[s]), "left")
    return rows.filter(cutoffs.score(names[5 : 5 + len(RULES)]) < F.coalesce(F.col(cut), F.lit(LEVELS))).select(*(f"`{c}`" for c in docs.columns))
