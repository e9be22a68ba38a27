"""Registered queries against their DuckDB statements on the smallest tables."""

import duckdb
import pytest

from rangeweave.llm import oracles, queries
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, data), con.sql(oracles.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    assert got and got == sorted(tuple(map(plain, r)) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall())


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
