"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from mensura.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    r = duck.execute(ORACLE_SQL[name])
    assert got == _rows(r.fetchall(), [d[0] for d in r.description])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
