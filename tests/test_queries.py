"""Every registered query against its SQL twin at the scale of the correctness gate (lineitem keys are unique there); queries without one must return rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    message, ok = compare(spark, con, QUERIES[key], ORACLES.get(key), SF)
    assert ok, message


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 11
    assert df.columns == ["label", "n_rows", "weighted_f1", "accuracy", "weighted_precision", "weighted_recall"]


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
