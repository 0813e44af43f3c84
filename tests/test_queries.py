"""Every query with SQL of its own agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in values)


def agree(spark, name, call, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql)
    got = call(spark, SF)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query(spark, name):
    agree(spark, name, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
