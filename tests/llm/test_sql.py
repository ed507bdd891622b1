"""The queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from chainlake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(str, want.fetchall()))
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == rows
