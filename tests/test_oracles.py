"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from corpusloom.plans.oracles import SQL
from corpusloom.plans.queries import QUERIES


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted(repr([None if pd.isna(v) else v for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_all_queries_have_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    expected = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
