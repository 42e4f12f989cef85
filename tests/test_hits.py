"""Hit tables held against their SQL where its order leaves ties open."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def test_of_equal_hits_the_first_of_the_table_counts(spark, tmp_path):
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    rows = lambda order, part: pa.table({"l_orderkey": pa.array(order, pa.int64()), "l_partkey": pa.array(part, pa.int64()), "l_quantity": [5.0] * len(order), "l_linenumber": pa.array([1] * len(order), pa.int32())})
    # Spark reads the larger file first.
    pq.write_table(rows([1, 2, 1], [11, 21, 12]), folder / "a.parquet")
    pq.write_table(rows([2, 1, *range(3, 3000)], [22, 13, *range(3, 3000)]), folder / "b.parquet")
    want = duckdb.execute(entry.oracle_sql()["hit_table"].replace("FROM lineitem", f"FROM '{folder}/*.parquet'")).fetchall()
    got = [tuple(r) for r in entry.queries()["hit_table"](spark, str(tmp_path)).collect()]
    assert len(got) == 2999 and sorted(got) == sorted(want) and dict((r[0], r[1]) for r in got)["o1"] == "p11"
