"""Every registered query against its SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tablemill import catalog
from tools.check_queries import NAMES, table

FOLDER = "/root/testdata/sf0.001"
catalog.load()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert mine[1]
        return
    result = db.execute(ORACLES[name])
    assert mine == table([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_mktsegment", "n_orders", "total"]
    assert entry.entry(spark).count() == 5


def test_names_agree():
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
