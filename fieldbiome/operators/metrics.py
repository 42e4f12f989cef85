"""Recall by identity bin and regime, weighted precision, recall and F1, and gaps between methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions.coerce import safe_ratio
from fieldbiome.functions.settings import Bins


def binned_recall(rows: DataFrame, bins: Bins, value: str, methods: dict[str, str]) -> DataFrame:
    """Per bin n and the recall of each method (name -> 0/1 column); empty bins stay with n = 0 and null recalls."""
    sums = [F.sum(F.col(c).cast("long")).alias(f"__{m}") for m, c in methods.items()]
    counted = rows.withColumn("identity_bin", bins.key(F.col(value))).where("identity_bin is not null").groupBy("identity_bin").agg(F.count("*").alias("n"), *sums)
    frame = rows.sparkSession.createDataFrame([(k, a) for k, a, _, _ in bins.rows], "identity_bin string, lower double")
    joined = frame.join(counted, "identity_bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("identity_bin", "lower", "n", *[safe_ratio(F.col(f"__{m}").cast("double"), F.col("n")).alias(f"{m}_recall") for m in methods])


def regime_recall(rows: DataFrame, bins: Bins, value: str, methods: dict[str, str], low_max: float, high_min: float) -> DataFrame:
    """(method, overall, low, high) recalls: overall counts all rows; low and high those in bins up to, and from, an edge."""
    v = F.col(value)
    low_bins, high_bins = [r for r in bins.rows if r[2] <= low_max], [r for r in bins.rows if r[1] >= high_min]
    inside = lambda chosen: F.coalesce(bins.key(v).isin([r[0] for r in chosen]), F.lit(False)) if chosen else F.lit(False)
    marked = rows.select(inside(low_bins).alias("low"), inside(high_bins).alias("high"), F.explode(F.map_from_arrays(F.array(*map(F.lit, methods)), F.array(*[F.col(c).cast("double") for c in methods.values()]))).alias("method", "ok"))
    return marked.groupBy("method").agg(
        F.avg("ok").alias("overall_recall"),
        F.avg(F.when(F.col("low"), F.col("ok"))).alias("low_id_recall"),
        F.avg(F.when(F.col("high"), F.col("ok"))).alias("high_id_recall"),
    )


def fixed_bin(pident: str) -> F.Column:
    """Closed at the top, unlike Bins: 100 is in the last one."""
    p = F.col(pident)
    return F.when(p < 40, "lt_40").when(p < 70, "40_to_70").when(p < 90, "70_to_90").otherwise("90_to_100")


def weighted_metrics(rows: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Support-weighted precision, recall and F1 over the union of true and predicted classes; 0 where a class has none.

    The confusion counts are aggregated first, so only (class, class) pairs move further.
    """
    by = by or []
    cells = rows.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("x"))
    per = sides.groupBy(*by, F.col("x.label").alias("label")).agg(F.sum("x.support").alias("s"), F.sum("x.said").alias("m"), F.sum("x.hit").alias("h"))
    pr = F.when(F.col("m") > 0, F.col("h") / F.col("m")).otherwise(F.lit(0.0))
    rc = F.when(F.col("s") > 0, F.col("h") / F.col("s")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("h") > 0, 2.0 * F.col("h") / (F.col("m") + F.col("s"))).otherwise(F.lit(0.0))
    mean = lambda x: F.sum(F.col("s") * x) / F.sum("s")
    return per.groupBy(*by).agg(mean(pr).alias("precision"), mean(rc).alias("recall"), mean(f1).alias("f1"), F.sum("s").alias("n"))


def scenario_metrics(rows: DataFrame, true: str, preds: dict[str, str], pident: str, threshold: float = 40.0) -> DataFrame:
    """Weighted metrics of each method over all rows and over those under an identity threshold."""
    long = rows.select(F.col(true).alias("__t"), F.col(pident).alias("__i"), F.explode(F.map_from_arrays(F.array(*map(F.lit, preds)), F.array(*[F.col(c) for c in preds.values()]))).alias("method", "__p"))
    both = long.withColumn("scenario", F.explode(F.when(F.col("__i") < threshold, F.array(F.lit("all"), F.lit("low_identity"))).otherwise(F.array(F.lit("all")))))
    return weighted_metrics(both, "__t", "__p", ["scenario", "method"])


def recall_gap(table: DataFrame, first: str, second: str) -> DataFrame:
    """first - second in bins that have rows and both recalls."""
    kept = table.where((F.col("n") > 0) & F.col(first).isNotNull() & F.col(second).isNotNull())
    return kept.withColumn("delta_recall", F.col(first) - F.col(second))


def numeric_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns hold numbers ('', 'pending' and 'NA' don't)."""
    return table.where(" and ".join(f"try_cast(`{c}` as double) is not null" for c in columns))
