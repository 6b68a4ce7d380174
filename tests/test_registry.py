"""Every query of the library against the SQL that gives the same rows."""

import datetime
import math

import duckdb
import pytest

from tiersight import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET timezone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(plain(list(r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert got == sorted(repr(plain([r[at.index(c)] for c in columns])) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
