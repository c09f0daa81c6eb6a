"""Every registered query against the SQL that states the same result, run by DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from assayloom.plans import check_queries as catalogue

SF = "/root/testdata/sf0.001"
#: Queries that the smallest tables can't serve: combat needs two samples in each batch, the SQL of variance_by_feature equally many.
LARGER = dict.fromkeys(("combat", "variance_by_feature"), "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in {SF, *LARGER.values()}:
        c = found[folder] = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return found


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    folder = LARGER.get(name, SF)
    df = catalogue.QUERIES[name](spark, folder)
    want = duck[folder].sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: [(v is None, f"{v:+024.6f}" if isinstance(v, float) else str(v)) for v in r]
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=key)
    rows = sorted(([r[i] for i in at] for r in want.fetchall()), key=key)
    assert len(got) == len(rows)
    assert all(same(a, b) for x, y in zip(got, rows, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
