"""What is checked on literals: the results of the engine and of DuckDB are equal."""

import duckdb
import pytest

from larkspur.plans import run_queries  # noqa: F401 (registers its own)
from larkspur.plans.text_queries import FIXED


@pytest.mark.parametrize("name", sorted(FIXED))
def test_literals(spark, name):
    query, sql = FIXED[name]
    df = query(spark, "")
    want = duckdb.connect().sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
