"""Streamed lags with late rows, and the keyed store: replays, buckets, old files."""

import random

import pytest
from pyspark.sql import functions as F

from fieldbiome.streaming import lags, store

SERIES = "series string, ts timestamp, v double"


def day(n):
    return f"2024-01-{n:02d} 00:00:00"


def add(spark, rows, path):
    spark.createDataFrame(rows, "series string, t string, v double").select("series", F.to_timestamp("t").alias("ts"), "v").coalesce(1).write.mode("append").parquet(path)


def test_lags_wait_for_late_rows(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    seen = []
    for rows in (
        [("a", day(1), 1.0), ("a", day(4), 4.0), ("b", day(2), 5.0)],
        [("a", day(3), 3.0), ("a", day(2), 2.0), ("b", day(9), 9.0)],  # within three days of the newest row
        [("a", day(5), 5.0), (None, day(5), 5.0)],  # late by now: three days before the ninth
        [("end", "2024-03-01 00:00:00", 0.0)],
        [("end", "2024-03-09 00:00:00", 0.0)],
    ):
        add(spark, rows, src)
        stream = spark.readStream.schema(SERIES).parquet(src)
        got = lags.lagged(stream, "series", "ts", ["v"], 2, late="3 days")
        got.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((r["series"], r["ts"].day, r["v"], r["v_lag1"], r["v_lag2"], r["d_v"]) for r in spark.read.schema(got.schema).parquet(out).where("series <> 'end'").collect()))
    want = [("a", 1, 1.0, None, None, None), ("a", 2, 2.0, 1.0, None, 1.0), ("a", 3, 3.0, 2.0, 1.0, 1.0), ("a", 4, 4.0, 3.0, 2.0, 1.0), ("b", 2, 5.0, None, None, None), ("b", 9, 9.0, 5.0, None, 4.0)]
    plain = lambda rows: [tuple(None if x != x else x for x in r) for r in rows]
    assert plain(seen[-1]) == want
    assert ("b", 9) not in [(r[0], r[1]) for r in seen[2]] and len(seen[0]) <= len(seen[1]) <= len(seen[-1])


def test_lags_of_tables(spark):
    df = spark.createDataFrame([("a", day(2), 2.0), ("a", day(1), None), ("a", day(3), 7.0), (None, day(1), 1.0), ("b", None, 1.0)], "series string, t string, v double").select("series", F.to_timestamp("t").alias("ts"), "v")
    rows = [(r["ts"].day, r["v"], r["v_lag1"], r["d_v"]) for r in lags.lagged(df, "series", "ts", ["v"], 1).orderBy("ts").collect()]
    assert rows == [(1, None, None, None), (2, 2.0, None, None), (3, 7.0, 2.0, 5.0)]


SCHEMA = "k string, v int, ts int"


@pytest.mark.parametrize("order", ["ts", None])
def test_store_equals_a_dictionary(spark, tmp_path, order):
    rng, path, want = random.Random(3), f"{tmp_path}/t", {}
    for n in range(6):
        rows = [(rng.choice([None, *"abcdefghij"]), rng.randrange(100), rng.randrange(50)) for _ in range(rng.randrange(8))]
        df = spark.createDataFrame(rows, SCHEMA)
        touched = store.put(df, n, path, "k", order, buckets=4, keep=2)
        assert len(touched) <= len({r[0] for r in rows if r[0]})
        again = store.put(df, n, path, "k", order, buckets=4, keep=2)  # a batch that runs again
        assert again == touched
        best = {}
        for k, v, t in rows:
            if k is not None and (k not in best or ((t, v, t) if order else (v, t)) > ((best[k][1], *best[k]) if order else best[k])):
                best[k] = (v, t)
        for k, x in best.items():
            if not order or k not in want or (x[1], *x) > (want[k][1], *want[k]):
                want[k] = x
        assert {r["k"]: (r["v"], r["ts"]) for r in store.table(spark, path, SCHEMA).collect()} == want
    assert len(list((tmp_path / "t/lists").glob("[0-9]*"))) <= 2
    assert len(list((tmp_path / "t/data").glob("batch=*/bucket=*"))) <= 8  # what two lists name


def test_a_batch_touches_its_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.put(spark.createDataFrame([(c, 1, 1) for c in "abcdefghijklmnop"], SCHEMA), 0, path, "k", "ts", buckets=8)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t/data/batch=0").rglob("*.parquet")}
    touched = store.put(spark.createDataFrame([("a", 2, 2)], SCHEMA), 1, path, "k", "ts", buckets=8)
    assert len(touched) == 1 and [f.name for f in (tmp_path / "t/data/batch=1").glob("bucket=*")] == [f"bucket={touched[0]}"]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t/data/batch=0").rglob("*.parquet")} == before
    assert store.table(spark, path, SCHEMA).count() == 16 and store.table(spark, f"{tmp_path}/none", SCHEMA).count() == 0
