"""The operators that SQL can express give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from quillspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
