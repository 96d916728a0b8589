"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from netquarry import oracle, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    made.execute("SET timezone = 'UTC'")
    for table in ("events", "pages"):
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    return made


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    want = duck.execute(oracle.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
