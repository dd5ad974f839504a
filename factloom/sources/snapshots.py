"""Snapshots and graph files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("classes", "relations", "entities", "triples", "communities")
META, META_FOLDER = "saved long, version int, folder string, tables string", "versions"
#: "&" is first to be escaped and last to be read.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"))
FORMATS = ("parquet", "node_link", "graphml", "gexf")


def save_snapshot(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """A new folder of Parquet tables, and then the row that names it: readers see the snapshot before until all tables are whole."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    spark, folder, now = next(iter(tables.values())).sparkSession, f"v{version}-{uuid.uuid4().hex}", time.time_ns()
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    spark.createDataFrame([(now, version, folder, ",".join(sorted(tables)))], META).coalesce(1).write.mode("append").parquet(f"{path}/{META_FOLDER}")


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, DataFrame], int]:
    """The last snapshot saved, or the last of the given version."""
    rows = spark.read.schema(META).parquet(f"{path}/{META_FOLDER}")
    meta = (rows if version is None else rows.filter(F.col("version") == version)).orderBy(F.col("saved").desc()).first()
    if meta is None:
        raise ValueError(f"no snapshot of version {version} at {path}")
    return {t: spark.read.parquet(f"{path}/{meta['folder']}/{t}") for t in meta["tables"].split(",") if t}, meta["version"]


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """parquet (two tables), node_link (JSON lines, one node or link a line), graphml or gexf (text parts between a head and a tail).

    Rows are written by the tasks; nothing is gathered.  The parts of graphml and gexf, in order of name, are one document.
    """
    if fmt == "parquet":
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        edges.write.mode("overwrite").parquet(f"{path}/edges")
    elif fmt == "node_link":
        n = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), "id", "kind", "label", "attributes")).alias("value"))
        e = edges.select(F.to_json(F.struct(F.lit("link").alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "key", "attributes")).alias("value"))
        n.unionByName(e).write.mode("overwrite").text(path)
    elif fmt == "graphml":
        n = nodes.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), _xml("id"), F.lit('">'), _data("kind"), _data("label"), _data("attributes"), F.lit("</node>")).alias("value"))
        e = edges.select(F.lit(3).alias("o"), F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('">'), _data("kind"), _data("key"), _data("attributes"), F.lit("</edge>")).alias("value"))
        keys = "".join(f'<key id="{k}" for="all" attr.name="{k}" attr.type="string"/>' for k in ("kind", "label", "key", "attributes"))
        head = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
        _write_document(n, e, head, "", "</graph></graphml>", path)
    elif fmt == "gexf":
        n = nodes.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), _xml("id"), F.lit('" label="'), _xml("label"), F.lit('"><attvalues>'), _value("kind"), _value("attributes"), F.lit("</attvalues></node>")).alias("value"))
        e = edges.select(F.lit(3).alias("o"), F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><attvalues>'), _value("kind"), _value("key"), _value("attributes"), F.lit("</attvalues></edge>")).alias("value"))
        names = lambda of, *ks: f'<attributes class="{of}">' + "".join(f'<attribute id="{k}" title="{k}" type="string"/>' for k in ks) + "</attributes>"
        head = f'<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">{names("node", "kind", "attributes")}{names("edge", "kind", "key", "attributes")}<nodes>'
        _write_document(n, e, head, "</nodes><edges>", "</edges></graph></gexf>", path)
    else:
        raise ValueError(f"unknown graph format {fmt!r}; known: {', '.join(FORMATS)}")


def _write_document(nodes: DataFrame, edges: DataFrame, head: str, middle: str, tail: str, path: str) -> None:
    ends = nodes.sparkSession.createDataFrame([(0, head), (2, middle), (4, tail)], "o int, value string")
    # A hash after the place deals nodes and edges over many parts; head and tail stay first and last.
    rows = ends.unionByName(nodes).unionByName(edges).withColumn("h", F.xxhash64("value"))
    rows.repartitionByRange("o", "h").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def _value(column: str):
    return F.concat(F.lit(f'<attvalue for="{column}" value="'), _xml(column), F.lit('"/>'))


def _xml(column: str):
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _plain(column):
    for raw, safe in reversed(ESCAPES):
        column = F.replace(column, F.lit(safe), F.lit(raw))
    return column


def _between(left: str, right: str, name: str):
    """What stands between two pieces of markup of a line; no value holds any, as it is escaped."""
    return _plain(F.substring_index(F.substring_index("value", left, -1), right, 1)).alias(name)


def _elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The lines that hold an element.  Parts aren't documents of their own, and splits of them even less, so no XML reader sees them."""
    return spark.read.option("lineSep", "\n").text(path).filter(F.col("value").startswith(f"<{tag} "))


def _data(column: str):
    return F.concat(F.lit(f'<data key="{column}">'), _xml(column), F.lit("</data>"))


def load_graph(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as saved, in files of ``save_graph``: an element a line."""
    if fmt == "parquet":
        return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if fmt == "node_link":
        rows = spark.read.schema("type string, id string, kind string, label string, attributes string, source string, target string, key string").json(path)
        nodes = rows.filter("type = 'node'").select("id", "kind", "label", "attributes")
        return nodes, rows.filter("type = 'link'").select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", "key", "attributes")
    if fmt == "graphml":
        data = lambda k: _between(f'<data key="{k}">', "</data>", k)
        n, e = _elements(spark, path, "node"), _elements(spark, path, "edge")
        nodes = n.select(_between('<node id="', '"', "id"), data("kind"), data("label"), data("attributes"))
        return nodes, e.select(_between('<edge source="', '"', "src"), _between('" target="', '"', "dst"), data("kind"), data("key"), data("attributes"))
    if fmt == "gexf":
        value = lambda k: _between(f'<attvalue for="{k}" value="', '"', k)
        n, e = _elements(spark, path, "node"), _elements(spark, path, "edge")
        nodes = n.select(_between('<node id="', '"', "id"), value("kind"), _between('" label="', '"', "label"), value("attributes"))
        return nodes, e.select(_between('<edge source="', '"', "src"), _between('" target="', '"', "dst"), value("kind"), value("key"), value("attributes"))
    raise ValueError(f"unknown graph format {fmt!r}; known: {', '.join(FORMATS)}")
