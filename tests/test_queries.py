import math
import os

import duckdb
import pytest

import __spark_entry__

NAMES = sorted(__spark_entry__.queries())
ORACLES = __spark_entry__.oracle_sql()
#: Queries that find nothing in these tables, as they should.
EMPTY = {"profile_redundant"}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def tidy(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, data, con, name):
    df = __spark_entry__.queries()[name](spark, data)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert cols and rows
        return
    cur = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    want = sorted((tuple(tidy(r[at[c]]) for c in sorted(at)) for r in cur.fetchall()), key=repr)
    assert cols == sorted(at) and (want or name in EMPTY)
    assert sorted((tuple(tidy(r[c]) for c in cols) for r in rows), key=repr) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(NAMES)
