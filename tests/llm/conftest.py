import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; sources and languages rotate, with nulls among them; extra columns clash with internal names."""

    def make(texts, ids=None, clash=True):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, ["en", "de", None][k % 3], ["a", "b", None, "a", "a"][k % 5], len(t or ""), k, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        df = spark.createDataFrame(rows, DOC + ", size long, fp string")
        return df if clash else df.drop("size", "fp")

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest driver table of documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(200)
