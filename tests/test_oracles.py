"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from fieldlens import catalog


def rows(df, cols):
    out = []
    for r in df[cols].astype(object).itertuples(index=False):
        out.append(str(tuple(None if v is None or v != v else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, small, duck, name):
    got, want = catalog.queries()[name](spark, small).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
