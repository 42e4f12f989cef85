"""Event streams: windowed totals with late data, dedupe, and keyed upserts. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldbiome.functions.scratch import folders, remove


def windowed(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """(event_type, start, n, total) by tumbling windows; events later than the watermark are let go in streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) by session windows."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """One event for each key; in streams, state is kept as long as the watermark allows."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def upserted(stream: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None, keep: int = 2) -> StreamingQuery:
    """Keeps a Parquet table of the latest row for each key: each micro-batch is put into the newest version before it.

    Latest is by the column `order` (the largest value; of ties, and without order, the largest row). Version k is the folder
    v=k; a batch that runs again writes its own version anew. Versions but the newest `keep` are removed.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c != key]
        by = F.struct(*([order] if order else []), *others)
        rows = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(by.alias("by"), F.struct(*others).alias("row"))).alias("x"))
        rows = rows.select(*[F.col(key) if c == key else F.col(f"x.row.{c}").alias(c) for c in batch.columns])
        versions = sorted(int(f[2:]) for f in folders(spark, path) if f.startswith("v=") and f[2:].isdigit())
        before = [v for v in versions if v < number]
        if before:
            old = spark.read.parquet(f"{path}/v={before[-1]}")
            if order:  # a late event doesn't put a later one back
                both = old.unionByName(rows).groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("x"))
                rows = both.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in batch.columns])
            else:
                rows = old.join(rows.select(key), key, "left_anti").select(*batch.columns).unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")
        for v in [*before, number][:-keep]:
            remove(spark, f"{path}/v={v}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that upserted() keeps."""
    versions = [int(f[2:]) for f in folders(spark, path) if f.startswith("v=") and f[2:].isdigit()]
    if not versions:
        raise ValueError(f"no version in {path}")
    return spark.read.parquet(f"{path}/v={max(versions)}")
