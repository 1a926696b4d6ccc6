"""Every core query with SQL against DuckDB on the smallest data; those without are run."""

import os
from collections import Counter

import pytest

from colsieve.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem embeddings".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "quantize") else v
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(map(tuple, df.collect()), df.columns) == canonical(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__

    assert os.path.exists(__spark_entry__.__file__)
    assert __spark_entry__.entry(spark).count() == 80
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
