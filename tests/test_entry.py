"""The driver contract: names, and results against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "sample_metrics" in entry.queries()


@needs_data
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns


#: The training-data operators' queries have tests of their own.
CORE = sorted(n for n in entry.oracle_sql() if not n.startswith("op") or not n[2].isdigit())


@needs_data
@pytest.mark.parametrize("name", [n for n in CORE if n != "pipeline"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    plain = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(r[got.columns.index(c)]) for c in columns) for r in got.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want
