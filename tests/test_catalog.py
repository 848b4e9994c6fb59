"""Every registered query against its SQL counterpart on the smallest sample."""

import math

import duckdb
import pytest

from catalog.oracle import ORACLE
from catalog.registry import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return con


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return "nan" if math.isnan(value) else f"{float(value):.5f}".replace("-0.00000", "0.00000")
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as spark_entry

    assert spark_entry.entry(spark).count() > 0
    assert set(spark_entry.queries()) >= set(spark_entry.oracle_sql())
