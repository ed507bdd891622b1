"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 4)
    return int(v) if isinstance(v, bool) is False and hasattr(v, "__int__") and not isinstance(v, (str, bytes)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} - {"pipeline"}))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
