"""Ordered panels: lags, differences, correlations, trends and ranks of cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.operators.ranking import placed


def lagged(panel: DataFrame) -> DataFrame:
    """panel (study, order, mge_abundance, arg_total, ...) with arg_t1, arg_t2, mge_t1, d_mge_t and d_arg_t1.

    Rows with nulls in the ordered values go first, so gaps close up; null studies go too. One sort serves all columns.
    """
    rows = panel.where("study is not null and `order` is not null and mge_abundance is not null and arg_total is not null")
    w = Window.partitionBy("study").orderBy("order")
    lead = lambda c, n: F.lead(c, n).over(w)
    out = rows.select("*", lead("arg_total", 1).alias("arg_t1"), lead("arg_total", 2).alias("arg_t2"), lead("mge_abundance", 1).alias("mge_t1"), (F.col("mge_abundance") - F.lag("mge_abundance", 1).over(w)).alias("d_mge_t"))
    return out.withColumn("d_arg_t1", F.col("arg_t1") - F.col("arg_total"))


def pair_correlation(a: str, b: str) -> tuple[Column, Column]:
    """Aggregates: the correlation over complete pairs (null under two), and their number."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    n = F.count_if(both)
    return F.when(n >= 2, F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))), n


def lag_correlations(panel: DataFrame) -> DataFrame:
    """(lag, correlation, n) of mge_abundance with arg_total 0, 1 and 2 steps on, in one pass."""
    aggs = []
    for k, c in enumerate(("arg_total", "arg_t1", "arg_t2")):
        r, n = pair_correlation("mge_abundance", c)
        aggs += [r.alias(f"r{k}"), n.alias(f"n{k}")]
    one = lagged(panel).agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("correlation"), F.col(f"n{k}").alias("n")) for k in range(3)])))


def trends(panel: DataFrame, value: str) -> DataFrame:
    """(study, first, last, trend, word): the last against the first value that isn't null."""
    v = panel.where(F.col("study").isNotNull() & F.col(value).isNotNull()).groupBy("study").agg(F.min_by(value, "order").alias("first"), F.max_by(value, "order").alias("last"), F.count("*").alias("n"))
    trend = F.when(F.col("n") < 2, "unavailable").when(F.col("last") > F.col("first"), "increasing").when(F.col("last") < F.col("first"), "decreasing").otherwise("stable")
    word = F.when(F.col("trend") == "increasing", "up").when(F.col("trend") == "decreasing", "down").when(F.col("trend") == "stable", "flat").otherwise("NA")
    return v.withColumn("trend", trend).withColumn("word", word)


def baseline_ranks(panel: DataFrame, value: str) -> DataFrame:
    """(study, base, rank from 0, label): cohorts by their first value, missing last."""
    base = panel.where("study is not null").groupBy("study").agg(F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("order"))).alias("base"))
    total = base.agg(F.count("*").alias("total"))  # one row
    ranked = placed(base, [F.col("base").asc_nulls_last(), F.col("study")], name="rank").withColumn("rank", (F.col("rank") - 1).cast("int")).join(F.broadcast(total))
    share = F.col("rank") / (F.col("total") - 1)
    low, high = F.lit("lower starting ARG burden"), F.lit("higher starting ARG burden")
    label = (
        F.when(F.col("total") <= 1, "single cohort")
        .when(F.col("total") == 2, F.when(F.col("rank") == 0, low).otherwise(high))
        .when(F.col("total") == 3, F.element_at(F.array(F.lit("lowest starting ARG burden"), F.lit("middle starting ARG burden"), F.lit("highest starting ARG burden")), (F.col("rank") + 1).cast("int")))
        .when(share <= 0.33, low)
        .when(share >= 0.67, high)
        .otherwise("middle starting ARG burden")
    )
    return ranked.withColumn("label", label).drop("total")
