"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, tables, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    wanted = tables.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.select(*names).collect()))) == sorted(map(str, wanted))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["entity", "coupled", "degree", "average_revs"]
    assert set(SQL) <= set(QUERIES)


def test_the_rest_works_without_the_training_data_package(tmp_path):
    root, copy = os.path.dirname(os.path.abspath(__spark_entry__.__file__)), tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'coupling' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for _ in range(2):  # with the pipeline's file left in place, then without
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, check=True, capture_output=True)
