"""Every query with SQL gives the rows that DuckDB gives for the SQL on the same tables; every other one runs."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.conftest import DATA, plain
from weft.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert df.columns
        return
    found = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
