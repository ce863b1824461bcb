"""Every registered query against its SQL, over the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarrystone.plans import catalog


def cell(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if hasattr(x, "tolist"):
        x = x.tolist()
    return tuple(map(cell, x)) if isinstance(x, (list, tuple)) else x


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(x) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=repr)


def sql(small, query):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c.execute(query).df()


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    got = catalog.queries()[name](spark, small).toArrow().to_pandas()
    want = sql(small, catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() >= 0


def test_flagship(spark):
    if not os.path.isdir(entry.DATA):
        pytest.skip("no test tables here")
    assert entry.entry(spark).first().context.count("[chunk ") == 6
