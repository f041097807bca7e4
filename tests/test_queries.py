"""Every registered query against its SQL on the smallest data, and registry rules."""

import os
import pathlib
import re
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import __spark_entry__ as driver  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
CORPUS = re.compile(r"op\d+_|pipeline$")  # covered by tests/llm, where that package is present
QUERIES = {n: fn for n, fn in driver.queries().items() if not CORPUS.match(n)}
ORACLES = {n: sql for n, sql in driver.oracle_sql().items() if not CORPUS.match(n)}
SLOW = {"model_benchmark", "train_and_report", "master_toxicity", "model_save_load_score", "train_logistic"}  # covered by tests/test_models.py and tools/check.py


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_registry():
    assert ORACLES.keys() <= QUERIES.keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.count() == 4 and "alert_level" in rows.columns


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    names, got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    result = db.execute(ORACLES[name])
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    assert names == want_names
    assert got == want
