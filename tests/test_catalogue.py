"""Every registered query against its SQL equivalent on the smallest tables."""

import os

import duckdb
import pytest

from loomspark.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{DIR}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value.item() if hasattr(value, "item") else value)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())
    assert got == want


def test_bootstrap_holds_the_rate(spark):
    row = catalogue.queries()["cluster_interval"](spark, DIR).first()
    assert row.lo <= row.rate <= row.hi and row.resamples == 5000
    assert row == catalogue.queries()["cluster_interval"](spark, DIR).first()


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
