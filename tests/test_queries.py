"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from candlemill.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(None if r[i] is None else r[i] for i in order) for r in rows),
        key=lambda r: tuple((v is None, "" if v is None else v) for v in r),
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    found = duck.sql(entry_point.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert plain(got, df.columns) == plain(found.fetchall(), found.columns)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns[-1] == "pattern" and df.count() > 0
    assert isinstance(df.limit(1).toPandas(), pd.DataFrame)
