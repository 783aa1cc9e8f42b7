"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest

from claimloom.plans.queries import QUERIES, SQL
from tests.oracle import connect, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    mine, theirs = QUERIES[name](spark, FOLDER).toPandas(), con.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_passages_of_few_words(spark):
    from claimloom.operators.claims import passages_in

    docs = spark.createDataFrame([(1, "a bc d ef g"), (2, None), (3, "bc d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "bc d"), (2, "c d e"), (3, ""), (4, None), (5, "bc d ef")], "item_id long, text string")
    assert sorted(map(tuple, passages_in(docs, items).collect())) == [(1, 1), (1, 3), (2, 1), (5, 1)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operations(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    shutil.copytree(repo / "claimloom", tmp_path / "claimloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'dup_ids' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"})
