"""A keyed table that streams keep up to date, in hash buckets: a batch reads and writes only the buckets of its keys.

The table is a folder of bucket files, data/batch=<n>/bucket=<b>, and small lists, lists/<n>, that name the batch which wrote each
bucket last. A batch writes its buckets first and its list last, so readers see it whole or not at all. Each batch starts from the
newest list before its own number; one that runs again writes the same files again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldbiome.functions.scratch import folders, remove


def _lists(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(f) for f in folders(spark, f"{path}/lists") if f.isdigit())


def _listed(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/lists/{number}").where("value <> ''").first()["value"])


def _latest(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """The row of each key with the largest `order` (of ties, and without one, the largest row)."""
    others = [c for c in rows.columns if c != key]
    by = F.struct(*([order] if order else []), *others)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("x"))
    return best.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns])


def put(batch: DataFrame, number: int, path: str, key: str, order: str | None = None, buckets: int = 32, keep: int = 4) -> list[int]:
    """Puts a batch into the table; returns the buckets that it touched. Rows without a key go.

    With an order, a row doesn't put back a later one. Lists but the newest `keep` go, with the bucket files that no list names.
    """
    spark = batch.sparkSession
    before = [n for n in _lists(spark, path) if n < number]
    now = _listed(spark, path, before[-1]) if before else {"buckets": buckets, "columns": batch.columns, "at": {}}
    count = now["buckets"]
    bucket = F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    rows = _latest(batch.where(F.col(key).isNotNull()), key, order).withColumn("bucket", bucket).persist()
    try:
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # buckets at most
        old = [f"{path}/data/batch={now['at'][str(b)]}/bucket={b}" for b in touched if str(b) in now["at"]]
        fresh = rows.drop("bucket")
        if old:
            held = spark.read.schema(fresh.schema).parquet(*old)
            if order:
                fresh = _latest(held.unionByName(fresh), key, order)
            else:
                fresh = held.join(fresh.select(F.col(key).alias("__put")), F.col(key) == F.col("__put"), "left_anti").unionByName(fresh)
        if touched:
            fresh.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
    finally:
        rows.unpersist()
    now["at"] |= {str(b): number for b in touched}
    spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lists/{number}")
    _tidied(spark, path, keep)
    return touched


def _tidied(spark: SparkSession, path: str, keep: int) -> None:
    lists = _lists(spark, path)
    for n in lists[:-keep]:
        remove(spark, f"{path}/lists/{n}")
    named = {(int(n), int(b)) for k in lists[-keep:] for b, n in _listed(spark, path, k)["at"].items()}
    for f in folders(spark, f"{path}/data"):
        n = int(f.removeprefix("batch="))
        mine = [int(b.removeprefix("bucket=")) for b in folders(spark, f"{path}/data/{f}") if b.startswith("bucket=")]
        for b in mine:
            if (n, b) not in named:
                remove(spark, f"{path}/data/{f}/bucket={b}")
        if n < lists[-1] and not any((n, b) in named for b in mine):
            remove(spark, f"{path}/data/{f}")


def table(spark: SparkSession, path: str, schema: object) -> DataFrame:
    """The rows of the newest list."""
    lists = _lists(spark, path)
    at = _listed(spark, path, lists[-1])["at"] if lists else {}
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(at.items())])


def kept_up(stream: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None, buckets: int = 32, keep: int = 4) -> StreamingQuery:
    """Puts each micro-batch of a stream into the table at path."""
    return stream.writeStream.foreachBatch(lambda batch, number: put(batch, number, path, key, order, buckets, keep) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
