"""Every case of `cases` against DuckDB over the same values, or against rows worked out by hand."""

import duckdb
import pytest

from .cases import CASES
from .test_queries import plain


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    sql, build = CASES[name]
    df = build(spark)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    cur = duckdb.sql(sql)
    assert sorted(cur.columns) == order
    assert got == sorted((tuple(plain(r[cur.columns.index(c)]) for c in order) for r in cur.fetchall()), key=str)
