"""Queries that run streams over files written from the test tables, with the SQL of what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbiome.functions.scratch import new_path
from fieldbiome.plans.registry import query
from fieldbiome.plans.tables import table
from fieldbiome.streaming import lags, store


@query("""WITH pn AS (SELECT event_type, date_trunc('day', ts) AS d, count(*)::DOUBLE AS m, sum(value) AS a FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
SELECT event_type AS study, CAST(epoch(d) AS BIGINT) AS day, m, round(a, 6) AS a, lag(m, 1) OVER w AS m_lag1, round(lag(a, 1) OVER w, 6) AS a_lag1, lag(m, 2) OVER w AS m_lag2, round(lag(a, 2) OVER w, 6) AS a_lag2,
m - lag(m, 1) OVER w AS d_m, round(a - lag(a, 1) OVER w, 6) AS d_a FROM pn WINDOW w AS (PARTITION BY event_type ORDER BY d)""")
def streamed_lags(spark, sf_dir):
    """Days of events in shuffled batches, streamed: lags and differences of each day's counts and sums."""
    source, out, check = (new_path(spark, x) for x in ("days", "lags", "checkpoint"))
    e = table(spark, sf_dir, "events").where("event_type is not null and ts is not null")
    days = e.groupBy(F.col("event_type").alias("study"), F.to_timestamp(F.date_trunc("day", "ts")).alias("ts")).agg(F.count("*").cast("double").alias("m"), F.sum("value").alias("a"))
    days.repartition(4, F.xxhash64("study", "ts")).write.parquet(source)
    # A last row, a thousand days on, tells that no others come.
    end = spark.range(1).select(F.lit("").alias("study"), (F.lit("2100-01-01").cast("timestamp")).alias("ts"), F.lit(0.0).alias("m"), F.lit(0.0).alias("a"))
    end.write.mode("append").parquet(source)
    stream = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 2).parquet(source)
    got = lags.lagged(stream, "study", "ts", ["m", "a"], 2, late="3650 days")
    got.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rounded = [F.round(c, 6).alias(c) for c in ("a", "a_lag1", "a_lag2", "d_a")]
    return spark.read.schema(got.schema).parquet(out).where("study <> ''").select("study", F.unix_timestamp("ts").alias("day"), "m", "m_lag1", "m_lag2", "d_m", *rounded)


@query("""SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, max(epoch_us(ts)) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1""")
def kept_up_users(spark, sf_dir):
    """Each user's last event, kept up to date by a stream of shuffled batches."""
    source, at, check = (new_path(spark, x) for x in ("events", "store", "checkpoint"))
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e.repartition(4, F.xxhash64("event_id")).write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store.kept_up(stream, at, "user_id", check, order="us").awaitTermination()
    return store.table(spark, at, e.schema)
