"""Entity alignment and near-duplicate facts, by blocking and verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import word_set, words
from factloom.plans import blocks
from factloom.plans.components import components
from factloom.plans.scratch import materialise


def prefix_pairs(rows: DataFrame, key: str, text: str, threshold: float, within: str | None = None) -> DataFrame:
    """a, b (a < b), overlap: all pairs whose word sets overlap by ``threshold`` or more, of rows equal in ``within`` if that is given.

    Prefix filtering: with words ordered from rare to frequent, such a pair shares a word among the first
    n - ceil(threshold * n) + 1 of each, so only those are joined.  Equal word sets are paired through
    their smallest key, not with each other, which keeps copies linear.
    """
    group = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))
    docs = materialise(rows.select(F.col(key).alias("id"), group.alias("g"), F.array_sort(word_set(text)).alias("w")).filter(F.size("w") > 0), "sets")
    reps = materialise(docs.groupBy("g", "w").agg(F.min("id").alias("id")).select("id", "g", "w"), "reps")
    copies = docs.select(F.col("id").alias("b"), "g", "w").join(reps.select(F.col("id").alias("a"), "g", "w"), ["g", "w"]).filter("a <> b").select("a", "b", F.lit(1.0).alias("overlap"))
    token = reps.select("id", F.explode(F.transform("w", lambda t: F.struct("g", t.alias("t")))).alias("t"))
    rare = token.join(token.groupBy("t").agg(F.count("*").alias("n")), "t")
    order = Window.partitionBy("id").orderBy("n", "t")
    ranked = rare.withColumn("r", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy("id")))
    prefix = materialise(ranked.filter(F.col("r") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select("id", "t", "size"), "prefixes")
    left, right = prefix.alias("x"), prefix.alias("y")
    close = (F.col("x.id") < F.col("y.id")) & (F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size"))
    pairs = left.join(right, (F.col("x.t") == F.col("y.t")) & close).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = pairs.join(reps.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(reps.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb")).cast("double") / F.size(F.array_union("wa", "wb"))
    return pairs.withColumn("overlap", shared).filter(F.col("overlap") >= threshold).select("a", "b", "overlap").unionByName(copies)


def alias_groups(entities: DataFrame, threshold: float = 0.6) -> DataFrame:
    """entity_id, group: entities that share a lower-cased name or alias, or whose names overlap by words."""
    names = entities.select("entity_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    keyed = names.select("entity_id", F.lower(F.trim("n")).alias("k")).filter("k <> ''")
    shared = keyed.join(keyed.groupBy("k").agg(F.min("entity_id").alias("first")), "k").filter("entity_id <> first").select(F.col("entity_id").alias("u"), F.col("first").alias("v"))
    links = shared.unionByName(prefix_pairs(entities, "entity_id", "name", threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = components(links).withColumnRenamed("node", "entity_id")
    return entities.select("entity_id").join(found, "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("group"))


def similar_vectors(rows: DataFrame, key: str, vector: str, threshold: float = 0.85) -> DataFrame:
    """a, b (a < b), cosine: all pairs at ``threshold`` or more, exactly.

    Every two groups of vectors meet in one task, which multiplies them by tiles and returns pairs only.  Work grows with the
    square of the number of vectors; memory of a task doesn't, and no candidate is shuffled.
    """
    if not threshold > 0:
        raise ValueError("need threshold > 0")
    kind = rows.schema[key].dataType.simpleString()
    count, n = rows.agg(F.count("*"), F.max(F.size(vector))).first()

    def each(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        found = []
        left = blocks.by_length(x)
        right = left if same else blocks.by_length(y)
        for i, p in enumerate(left):
            for q in right[i:] if same else right:
                for at, to, c in blocks.products(p, q):
                    r, s = np.nonzero(c >= threshold)
                    ok = at + r < to + s if p is q else slice(None)
                    r, s = r[ok], s[ok]
                    a, b = p.keys.take(pa.array(at + r)).combine_chunks(), q.keys.take(pa.array(to + s)).combine_chunks()
                    swap = pc.greater(a, b)
                    found.append(pa.table({"a": pc.if_else(swap, b, a), "b": pc.if_else(swap, a, b), "cosine": pa.array(np.minimum(c[r, s], 1.0))}))
        return pa.concat_tables(found) if found else pa.table({"a": x["id"][:0], "b": x["id"][:0], "cosine": pa.array([], pa.float64())})

    vectors = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return blocks.within(vectors, blocks.groups_of(count, n or 0, blocks.LEAST_GROUPS), each, f"a {kind}, b {kind}, cosine double").filter("a <> b")


def near_duplicate_triples(triples: DataFrame, threshold: float = 0.7) -> DataFrame:
    """a, b, overlap: facts with one relation whose "head tail evidence" words overlap by ``threshold`` or more."""
    text = triples.withColumn("_t", F.concat_ws(" ", "head_id", "tail_id", "evidence"))
    return prefix_pairs(text, "triple_id", "_t", threshold, within="relation_id")


def multiset_jaccard_of(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """keys, jaccard: word multisets compared by exploding and summing, for texts of any length; two empty texts give 1."""
    a = pairs.select(*keys, F.explode(words(left)).alias("_w"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = pairs.select(*keys, F.explode(words(right)).alias("_w"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    each = a.unionByName(b).groupBy(*keys, "_w").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    found = each.groupBy(*keys).agg((F.sum(F.least("_a", "_b")) / F.sum(F.greatest("_a", "_b"))).alias("jaccard"))
    return pairs.select(*keys).join(found, keys, "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(1.0)))
