"""Schema induction: chunks, proposals, merged classes and relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.ids import stable_id
from factloom.functions.text import squeezed, stripped


def chunks(documents: DataFrame, size: int = 4000, overlap: int = 400) -> DataFrame:
    """doc_id, chunk_index, text: windows of ``size`` words, each ``overlap`` words into the one before.

    A last window that lies wholly within its predecessor is kept.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    step = size - overlap
    tokens = F.filter(F.split(stripped("text"), r"(?U)\s+"), lambda w: w != "")
    rows = documents.select("doc_id", tokens.alias("_w")).filter(F.size("_w") > 0)
    rows = rows.select("doc_id", "_w", F.explode(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / step).cast("int"))).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, F.lit(size)), " ").alias("text"))


def schema_prompt(chunk_rows: DataFrame) -> DataFrame:
    """Adds ``prompt``, which asks a model for the classes and relations of a chunk."""
    total = Window.partitionBy("doc_id")
    text = F.concat(
        F.format_string("Part %d of %d.\n", F.col("chunk_index") + 1, F.count("*").over(total)),
        F.lit("List the kinds of things in the text and the relations between them as JSON with the keys entity_types, relations and notes.\n\n"), F.col("text"),
    )
    return chunk_rows.withColumn("prompt", text)


def propose(chunk_rows: DataFrame, proposer: Callable[[str], dict], schema: str) -> DataFrame:
    """Runs ``proposer`` (a model client or a rule) on each chunk in the workers; a failure fills ``error``, not the job."""
    ids = {f.name: f.dataType.simpleString() for f in chunk_rows.schema if f.name in ("doc_id", "chunk_index")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, errors = [], []
            for text in b["text"]:
                try:
                    replies.append(proposer(text))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any client error belongs to its row
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"doc_id": b["doc_id"], "chunk_index": b["chunk_index"], "reply": replies, "error": errors})

    return chunk_rows.select("doc_id", "chunk_index", "text").mapInPandas(run, f"doc_id {ids['doc_id']}, chunk_index {ids['chunk_index']}, reply {schema}, error string")


def capitalised_proposer(text: str) -> dict:
    """A deterministic stand-in for a model: capitalised words are classes, "A verbs B" is a relation."""
    import re

    kinds = sorted(set(re.findall(r"\b[A-Z][a-z]+\b", text)))
    facts = sorted(set(re.findall(r"\b([A-Z][a-z]+) ([a-z]+s) ([A-Z][a-z]+)\b", text)))
    return {
        "entity_types": [{"name": k, "description": "", "parent_names": [], "aliases": []} for k in kinds],
        "relations": [{"name": v, "description": "", "domain": a, "range": b, "direction": "directed", "symmetric": False, "transitive": False} for a, v, b in facts],
        "notes": "",
    }


def _key(name: str, compat: bool):
    return squeezed(name) if compat else F.lower(squeezed(name))


def _clean_union(column: str):
    """Sorted distinct non-blank strings of a column of arrays."""
    every = F.flatten(F.collect_list(F.coalesce(column, F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, stripped), lambda x: x != "")))


def _first(column: str, order: str, where=None):
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def class_support(proposals: DataFrame, min_support: int = 1, compat: bool = False, distinct_chunks: bool = False) -> DataFrame:
    """key, name, description, parents, aliases, support: proposed classes merged by name.

    ``proposals`` has doc_id, chunk_index and reply.  The first mention's name and the first description
    hold; support counts mentions, or chunks.  ``compat`` merges names with regard to case.
    """
    rows = proposals.select("doc_id", "chunk_index", F.posexplode("reply.entity_types").alias("_i", "_c"))
    rows = rows.select(F.struct("doc_id", "chunk_index", "_i").alias("_at"), "_c.*").withColumn("key", _key("name", compat)).filter("key <> ''")
    support = F.count_distinct(F.struct("_at.doc_id", "_at.chunk_index")) if distinct_chunks else F.count("*")
    merged = rows.groupBy("key").agg(
        F.min_by(stripped("name"), "_at").alias("name"), F.coalesce(_first("description", "_at", F.col("description") != ""), F.lit("")).alias("description"),
        _clean_union("parent_names").alias("parents"), _clean_union("aliases").alias("aliases"), support.alias("support"),
    )
    return merged.filter(F.col("support") >= min_support)


def relation_support(proposals: DataFrame, min_support: int = 1, compat: bool = False) -> DataFrame:
    """key, name, description, domain, range, direction, symmetric, transitive, support: proposed relations merged by name."""
    rows = proposals.select("doc_id", "chunk_index", F.posexplode("reply.relations").alias("_i", "_r"))
    rows = rows.select(F.struct("doc_id", "chunk_index", "_i").alias("_at"), "_r.*").withColumn("key", _key("name", compat)).filter("key <> ''")
    end = lambda c: F.nullif(stripped(_first(c, "_at")), F.lit(""))
    merged = rows.groupBy("key").agg(
        F.min_by(stripped("name"), "_at").alias("name"), F.coalesce(_first("description", "_at", F.col("description") != ""), F.lit("")).alias("description"),
        end("domain").alias("domain"), end("range").alias("range"), F.coalesce(_first("direction", "_at", F.col("direction") != "directed"), F.lit("directed")).alias("direction"),
        F.coalesce(F.bool_or("symmetric"), F.lit(False)).alias("symmetric"), F.coalesce(F.bool_or("transitive"), F.lit(False)).alias("transitive"), F.count("*").alias("support"),
    )
    return merged.filter(F.col("support") >= min_support)


def schema_tables(classes: DataFrame, relations: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merged classes and relations with ids in place of names; parents and ends that aren't classes are dropped."""
    ids = classes.select("key", stable_id("cls", "name").alias("id"))
    parents = classes.select(stable_id("cls", "name").alias("class_id"), F.explode("parents").alias("_p")).withColumn("key", _key("_p", compat))
    parents = parents.join(ids, "key").filter("id <> class_id").groupBy("class_id").agg(F.array_sort(F.collect_set("id")).alias("parent_ids"))
    none = F.array().cast("array<string>")
    out = classes.withColumn("class_id", stable_id("cls", "name")).join(parents, "class_id", "left")
    out = out.select("class_id", "name", "description", F.coalesce("parent_ids", none).alias("parent_ids"), "aliases", F.create_map().cast("map<string,string>").alias("attributes"))
    rels = relations.withColumn("relation_id", stable_id("rel", "name"))
    for end in ("domain", "range"):
        found = ids.select(F.col("key").alias("_k"), F.col("id").alias(f"_{end}"))
        rels = rels.withColumn("_e", _key(end, compat)).join(found, F.col("_e") == F.col("_k"), "left").drop("_e", "_k")
    rels = rels.select("relation_id", "name", "description", F.col("_domain").alias("domain"), F.col("_range").alias("range"), "direction", "symmetric", "transitive", none.alias("aliases"))
    return out, rels


def induce(proposals: DataFrame, min_class_support: int = 1, min_relation_support: int = 1, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, relations) from proposals."""
    return schema_tables(class_support(proposals, min_class_support, compat), relation_support(proposals, min_relation_support, compat), compat)


def extended(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``base`` plus the rows of ``more`` whose key it lacks."""
    return base.unionByName(more.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def upserted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row, by ``order``, of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def name_index(rows: DataFrame, id_column: str, last: bool = False) -> DataFrame:
    """key, id: lower-cased names and aliases; of several owners the first (by ord) or the last holds, names before aliases."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    found = rows.select("ord", F.col(id_column).alias("id"), F.posexplode(names).alias("_i", "_n")).withColumn("key", F.lower(stripped("_n"))).filter("key <> ''")
    at = F.struct("ord", "_i")
    return found.groupBy("key").agg((F.max_by if last else F.min_by)("id", at).alias("id"))


def ancestry(classes: DataFrame, depth: int = 16) -> DataFrame:
    """class_id, ancestor_id, each class being its own ancestor; ends when a round adds nothing."""
    up = classes.select("class_id", F.explode("parent_ids").alias("ancestor_id"))
    every = classes.select("class_id", F.col("class_id").alias("ancestor_id")).unionByName(up).distinct()
    n = every.count()
    for _ in range(depth):
        step = every.alias("a").join(up.alias("b"), F.col("a.ancestor_id") == F.col("b.class_id")).select("a.class_id", "b.ancestor_id")
        every = every.unionByName(step).distinct()
        if (now := every.count()) == n:
            break
        n = now
    return every


def schema_brief(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """One row, ``brief``: the classes with their parents, then the relations with their ends, for prompts."""
    names = classes.select(F.col("class_id").alias("id"), F.col("name").alias("of"))
    parents = classes.select("class_id", F.explode_outer("parent_ids").alias("id")).join(names, "id", "left").groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_list("of")), ", ").alias("p"))
    lines = classes.join(parents, "class_id").select(F.lit(0).alias("part"), "name", F.concat(F.lit("- "), "name", F.when(F.col("p") != "", F.concat(F.lit(" is-a "), "p")).otherwise("")).alias("line"))
    ends = relations
    for e in ("domain", "range"):
        ends = ends.join(names.select(F.col("id").alias(e), F.col("of").alias(f"_{e}")), e, "left")
    more = ends.select(F.lit(1).alias("part"), "name", F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("_domain", F.lit("?")), F.lit(" → "), F.coalesce("_range", F.lit("?"))).alias("line"))
    rows = lines.unionByName(more)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "name", "line"))), lambda x: x["line"]), "\n").alias("brief"))
