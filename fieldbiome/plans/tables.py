"""Roles that the test tables play: customers are samples, brands are gene ids, regions are environments, events are a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbiome.operators import metric, similarity
from fieldbiome.functions.settings import Bins

#: Identity bins of the similarity benchmark (100 * top cosine lies between them).
BINS = Bins((25.0, 30.0, 35.0, 40.0, 45.0, 50.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str, arg: str = "p_brand") -> DataFrame:
    """(sample_id, arg_id, n): line items of a customer by brand, summed by order first so that little travels."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(arg).alias("arg_id"))
    by_order = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "arg_id").agg(F.count("*").alias("c"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
    return by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("sample_id", "arg_id").agg(F.sum("c").alias("n"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, environment, country, read_count); customers with a negative balance have none."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    depth = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("q").cast("long").alias("read_count"))
    customer = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = placed.join(depth, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("sample_id"), F.col("r_name").alias("environment"), F.col("n_name").alias("country"), F.coalesce("read_count", F.lit(0)).alias("read_count"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, order, mge_abundance, arg_total, entropy): events by type and day."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("study"), F.dayofmonth("ts").alias("order"), "value", "user_id")
    return e.groupBy("study", "order").agg(F.count("*").cast("double").alias("mge_abundance"), F.sum("value").alias("arg_total"), F.count_distinct("user_id").cast("double").alias("entropy"))


def did_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    return o.select(high.alias("treatment"), (F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp")).cast("int").alias("time"), F.col("o_totalprice").alias("y"))


def query_db(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), F.col("label").alias("true_label"))
    return q, e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("db_id"), F.col("embedding").alias("v"), "label")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = query_db(spark, sf_dir)
    return metric.best_parts(q.select("query_id", "v"), d).rows


def per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, pident, true_label, nearest and class_topk predictions, and whether they are right), from one pass over the pairs."""
    q, _ = query_db(spark, sf_dir)
    both = similarity.both_predicted(parts(spark, sf_dir)).withColumn("pident", F.round(100 * F.col("sim"), 6))
    out = both.join(q.select("query_id", "true_label"), "query_id")
    right = lambda c: (F.col(c) == F.col("true_label")).cast("int")
    return out.select("query_id", "pident", "true_label", "pred_nearest", "pred_topk", right("pred_nearest").alias("nearest_ok"), right("pred_topk").alias("topk_ok"))
