"""The operators that SQL can express, against DuckDB."""

import math

import duckdb
import pytest
from places import SF

from trialframe.llm import queries


def rows(df):
    cell = lambda x: "NULL" if x is None or isinstance(x, float) and math.isnan(x) else x
    return sorted(tuple(map(str, map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
