from factloom.operators.ontology import capitalised_proposer
from factloom.streaming import ingest


def test_schema_grows_with_the_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("doc_id string, text string").json(source)

    def feed(rows):
        spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.mode("append").json(source)
        ingest.grow_schema(stream, capitalised_proposer, out, str(tmp_path / "ck")).awaitTermination(120)

    feed([("a", "Cats chase Mice"), ("b", "Cats sleep")])
    assert {r["key"]: r["support"] for r in ingest.load_support(spark, out, 0).collect()} == {"cats": 2, "mice": 1}
    feed([("c", "Mice run from Dogs")])
    assert {r["key"]: r["support"] for r in ingest.load_support(spark, out, 1).collect()} == {"cats": 2, "mice": 2, "dogs": 1}
