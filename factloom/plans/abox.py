"""Facts from the star schema: a deterministic graph to run the operators on at any scale.

Entities are rows of region, nation, supplier, customer and part.  Facts: nation inRegion region; supplier and
customer basedIn nation; supplier supplies part.  Each fact is stated by one to three strategies, chosen by key, with an
evidence text that is exact, partial or missing; every head has a source document that may misspell its tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.sizing import dealt, scaled

RELATIONS = [("rel_in", "inRegion", "cls_nation", "cls_region"), ("rel_based", "basedIn", None, "cls_nation"), ("rel_supplies", "supplies", "cls_supplier", "cls_part")]
CLASSES = [("cls_place", "Place", []), ("cls_region", "Region", ["cls_place"]), ("cls_nation", "Nation", ["cls_place"]), ("cls_party", "Party", []), ("cls_supplier", "Supplier", ["cls_party"]), ("cls_customer", "Customer", ["cls_party"]), ("cls_part", "Part", [])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scaled(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, name, type_id, ord."""
    parts = [("region", "reg", "r_regionkey", "r_name"), ("nation", "nat", "n_nationkey", "n_name"), ("supplier", "sup", "s_suppkey", "s_name"), ("customer", "cus", "c_custkey", "c_name"), ("part", "par", "p_partkey", "p_name")]
    out = None
    for i, (name, prefix, key, label) in enumerate(parts):
        rows = table(spark, sf_dir, name).select(_id(prefix, key).alias("entity_id"), F.col(label).alias("name"), F.lit(f"cls_{name}").alias("type_id"), (F.col(key).cast("long") + F.lit(i * 10**12)).alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    return out


def facts(spark: SparkSession, sf_dir: str, supplies: bool = False) -> DataFrame:
    """key, head_id, relation_id, tail_id, head_name, relation_name, tail_name, ord."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("key"), _id("nat", "n_nationkey").alias("head_id"), F.lit("rel_in").alias("relation_id"), _id("reg", "r_regionkey").alias("tail_id"),
        F.col("n_name").alias("head_name"), F.lit("inRegion").alias("relation_name"), F.col("r_name").alias("tail_name"), F.col("n_nationkey").cast("long").alias("ord"),
    )
    for i, (name, prefix, key, label, at) in enumerate([("supplier", "sup", "s_suppkey", "s_name", "s_nationkey"), ("customer", "cus", "c_custkey", "c_name", "c_nationkey")], 1):
        more = dealt(table(spark, sf_dir, name), [key], 50_000).join(nation, F.col(at) == F.col("n_nationkey")).select(
            F.col(key).cast("long").alias("key"), _id(prefix, key).alias("head_id"), F.lit("rel_based").alias("relation_id"), _id("nat", "n_nationkey").alias("tail_id"),
            F.col(label).alias("head_name"), F.lit("basedIn").alias("relation_name"), F.col("n_name").alias("tail_name"), (F.col(key).cast("long") + F.lit(i * 10**12)).alias("ord"),
        )
        rows = rows.unionByName(more)
    if supplies:
        pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey", "l_partkey").distinct()  # few repeat: no hash table of a whole split
        pairs = pairs.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.unionByName(pairs.select(
            (F.col("s_suppkey") + F.col("p_partkey")).cast("long").alias("key"), _id("sup", "s_suppkey").alias("head_id"), F.lit("rel_supplies").alias("relation_id"), _id("par", "p_partkey").alias("tail_id"),
            F.col("s_name").alias("head_name"), F.lit("supplies").alias("relation_name"), F.col("p_name").alias("tail_name"), (F.col("s_suppkey").cast("long") * 10**9 + F.col("p_partkey") + F.lit(3 * 10**17)).alias("ord"),
        ))
    return rows


def statement(head: str = "head_name", relation: str = "relation_name", tail: str = "tail_name") -> Column:
    return F.concat_ws(" ", head, relation, tail)


def triples(spark: SparkSession, sf_dir: str, supplies: bool = False) -> DataFrame:
    """The pool: triple_id, head_id, relation_id, tail_id, evidence, source_doc_ids, strategy, confidence, is_verified, ord."""
    rows = facts(spark, sf_dir, supplies)
    rows = rows.withColumn("s", F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("key") % 2 == 0, 1), F.when(F.col("key") % 3 == 0, 2)))))
    strategy = F.element_at(F.array(F.lit("tot"), F.lit("open_ie"), F.lit("loose")), F.col("s") + 1)
    evidence = F.when(F.col("key") % 5 == 0, F.lit("")).when(F.col("key") % 5 == 1, F.col("head_name")).otherwise(statement())
    return rows.select(
        F.concat_ws(":", "head_id", "relation_id", "tail_id", F.col("s").cast("string")).alias("triple_id"), "head_id", "relation_id", "tail_id", evidence.alias("evidence"),
        F.array(F.lit("missing"), F.concat(F.lit("doc_"), "head_id")).alias("source_doc_ids"), strategy.alias("strategy"), (F.lit(0.5) + (F.col("key") % 4) / 10).alias("confidence"),
        F.lit(False).alias("is_verified"), (F.col("ord") * 3 + F.col("s")).alias("ord"),
    )


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: what is written about each head, every third document with a letter of the tail changed."""
    tail = F.when(F.col("key") % 3 == 1, F.replace(F.col("tail_name"), F.lit("A"), F.lit("E"))).otherwise(F.col("tail_name"))
    return facts(spark, sf_dir).withColumn("t", tail).select(F.concat(F.lit("doc_"), "head_id").alias("doc_id"), F.concat(F.lit("Records: "), statement(tail="t"), F.lit(".")).alias("text"))


def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select(F.lit("").alias("doc_id"), "ord", F.col("entity_id").alias("id"), "name")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, []) for c in CLASSES], "class_id string, name string, parent_ids array<string>, aliases array<string>").withColumn("description", F.lit("")).withColumn("ord", F.monotonically_increasing_id())


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, []) for r in RELATIONS], "relation_id string, name string, domain string, range string, aliases array<string>").withColumn("description", F.lit("")).withColumn("direction", F.lit("directed")).withColumn("ord", F.monotonically_increasing_id())


def verified(spark: SparkSession, sf_dir: str, supplies: bool = False) -> DataFrame:
    """One verified triple per fact."""
    rows = facts(spark, sf_dir, supplies)
    return rows.select(F.concat_ws(":", "head_id", "relation_id", "tail_id").alias("triple_id"), "head_id", "relation_id", "tail_id", statement().alias("evidence"), F.lit(True).alias("is_verified"), "ord")
