"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from factlake.plans import oracles
from factlake.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    rows = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[n] for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, plans.queries()[name], oracles.SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracles.SQL) == set(plans.queries())
