"""Every registered query with SQL against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from scopespark import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "-"
    if hasattr(x, "item"):
        x = x.item()
    return f"{float(x):.6g}" if isinstance(x, float) else str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_cell, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    assert rows_of(got) == rows_of(duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"kmeans_elbow"}))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
