"""The corpus queries that SQL can state, against DuckDB on whole tables."""

from pathlib import Path

import duckdb
import pytest

from assayloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
