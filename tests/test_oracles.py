"""Every query with a DuckDB twin gives the same rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, float) and x != x:
        return None
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted(rel.columns) == cols
    assert got == want


def test_metadata_merge_of_equal_places(spark, tmp_path):
    """Lines 1 and 2 of an order stand at the same place where their parts are 100,000 apart: the one that comes first in the table counts, as in the SQL on one thread."""
    lines = [(o, o + (200_000 if flip == k else 100_000), 1 + (flip != k)) for o, flip in ((o, o % 2) for o in range(40)) for k in (0, 1)]
    con = duckdb.connect()
    con.sql("set threads=1")
    rows = ", ".join(f"({o}, {p}, {n}::INT, 'R', 'O')" for o, p, n in lines)
    con.sql(f"copy (select * from (values {rows}) t(l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["metadata_merge"]).fetchall())
    got = sorted(map(tuple, registry.queries()["metadata_merge"](spark, str(tmp_path)).select("project", "title", "author").collect()))
    assert got == want == [(o, f"R{o + (200_000 if o % 2 == 0 else 100_000)}", f"O{o + (200_000 if o % 2 == 0 else 100_000)}") for o in range(40)]
