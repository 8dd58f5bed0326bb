"""The corpus queries that SQL can express against that SQL, in DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tessella import llm

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for path in Path(D).iterdir():
        base.execute(f"create view {path.stem} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    want = base.sql(llm.oracle_sql()[name])
    got = llm.queries()[name](spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(map(tuple, got.select(*want.columns).collect())) == plain(want.fetchall())
