import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from factloom.oracle import SQL
from factloom.queries import QUERIES

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names_without(tmp_path, *gone):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for g in gone:
        p = here / g
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=here, env=os.environ | {"PYTHONPATH": str(here)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_without_the_corpus_package(tmp_path):
    assert names_without(tmp_path, "factloom/llm", "tests/llm", "corpus_pipeline.py") == set(QUERIES)


def test_entry_with_an_empty_folder_left(tmp_path):
    (tmp_path / "x").mkdir()
    here = tmp_path / "x"
    names_without(here, "factloom/llm", "corpus_pipeline.py")
    (here / "repo/factloom/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert e.corpus is None and len(e.queries())"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=here / "repo", env=os.environ | {"PYTHONPATH": str(here / "repo")}).returncode == 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    """A value as text; null and NaN alike, whole floats as whole numbers."""
    if x is None or x != x:
        return ""
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


@pytest.mark.parametrize("name", [
    "multiset_jaccard", "best_window", "stable_ids", "hash_embedding", "vector_top_k", "chunks", "class_support", "induced_schema", "name_lookup", "extracted_entities",
    "merged_triples", "parsed_replies", "cascade", "checked_facts", "modularity", "connected_components", "community_summaries", "bm25_scores", "overlapping_names", "event_histogram",
    "beam_search", "beam_reports", "near_duplicate_facts", "similar_vectors", "tier_levels", "stored_graph", "cached_replies", "community_vectors",
])
def test_queries_equal_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows


@pytest.mark.parametrize("name", ["greedy_communities", "community_hierarchy"])
def test_communities_are_of_all_facts(spark, duck, name):
    """Every node of the entity graph is in a community, parts and what supplies them too."""
    rows = QUERIES[name](spark, SF)
    bottom = rows if name == "greedy_communities" else rows.filter("level = 0")
    nodes = duck.execute(f"SELECT count(*) FROM ({SQL['node_degrees']})").fetchone()[0]
    assert bottom.agg({"size": "sum"}).first()[0] == nodes


def test_broadcasts_are_bounded_in_bytes(spark):
    from factloom.plans.scratch import broadcast_below

    few = spark.createDataFrame([(i, "x" * 1000, [1.0] * 10) for i in range(100)], "i long, t string, v array<double>")
    hinted = lambda df: df._jdf.queryExecution().logical().toString().split("\n")[0]
    assert "broadcast" in hinted(broadcast_below(few, 100)).lower()
    assert "merge" in hinted(broadcast_below(few, 99)).lower()
    assert "merge" in hinted(broadcast_below(few, 100, 100_000)).lower()
    assert "broadcast" in hinted(broadcast_below(few.limit(0), 100)).lower()
