"""The operators' queries against their checking SQL, and the pipeline as a whole."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from oracle import compare, connect
from uptake.llm.catalog import ORACLES, QUERIES
from uptake.plans.stages import materialize

SF_DIR = os.environ.get("UPTAKE_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""


def test_pipeline_equals_plain_version(spark):
    """Each stage's effect, recomputed from the documents in plain Python."""
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    docs, langs = {r["doc_id"]: r["text"] for r in table}, {r["doc_id"]: r["lang"] for r in table}
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    from plain import contaminated, exact_keepers, language_keepers, near_keepers, token_ids

    kept = language_keepers(docs, langs)
    kept = exact_keepers(kept)
    kept = near_keepers(kept, 80)
    kept = {d: t for d, t in kept.items() if not contaminated(t, items)}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    for d, t in kept.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == d) == len(token_ids(t)) + 1


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert materialize(stage(spark, docs, SF_DIR)).columns == docs.columns


def test_entry_works_without_the_operators(tmp_path):
    """A copy of the library without the operators' folders still offers the other queries."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("uptake", "__spark_entry__.py"):
        os.symlink(os.path.join(root, name), tmp_path / name)
    os.remove(tmp_path / "uptake")
    os.mkdir(tmp_path / "uptake")
    for name in os.listdir(os.path.join(root, "uptake")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "uptake", name), tmp_path / "uptake" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [n for n in q if n.startswith('op')]; print('fine')"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    # the folder of the copy comes first, so that the original is not found
    out = subprocess.run([sys.executable, "-c", f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p != {root!r}]; {code}"],
                         cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "fine" in out.stdout, out.stderr
