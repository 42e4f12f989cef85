"""From hits to counts, normalised abundance, diversity and quality checks. Canonical form is long: (sample_id, arg_id, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.functions.coerce import key_or_na, pass_fail
from fieldbiome.functions.scratch import cut
from fieldbiome.operators.ranking import placed


def hit_counts(hits: DataFrame, sample: str = "sample_id", arg: str = "arg_id") -> DataFrame:
    """Rows per (sample, arg); repeated hits count."""
    return hits.where(F.col(arg).isNotNull()).groupBy(sample, arg).agg(F.count("*").alias("n"))


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Of rows with one key, the one of the largest order."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in others])


def positive(v: Column) -> Column:
    """v > 0, and not for NaN."""
    return (v > 0) & ~F.isnan(v)


def shannon(v: Column) -> Column:
    """Aggregate: diversity by natural logarithm over the positive values; 0 without any.

    ln(S) - sum(v ln v) / S needs one pass and no join with the totals.
    """
    x = F.when(positive(v), v)
    total = F.sum(x)
    return F.when(F.coalesce(total, F.lit(0.0)) > 0, F.log(total) - F.sum(x * F.log(x)) / total).otherwise(F.lit(0.0))


def normalised(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Counts over read_count. A left join: samples without metadata, or without depth, get 0."""
    depth = metadata.select("sample_id", "read_count")
    joined = counts.join(depth, "sample_id", "left")
    d = F.coalesce(F.col("read_count"), F.lit(0))
    return joined.select("sample_id", "arg_id", "n", F.when(d > 0, F.col("n") / d).otherwise(F.lit(0.0)).alias("normalised"))


def sample_metrics(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Totals, richness and diversity by sample. An inner join: samples without metadata are left out (see missing_metadata)."""
    v = F.col("n").cast("double")
    by_sample = counts.groupBy("sample_id").agg(F.sum(v).alias("arg_total"), F.count_if(positive(v)).alias("arg_richness"), shannon(v).alias("arg_diversity"))
    joined = by_sample.join(metadata, "sample_id")
    per_read = F.when(F.col("read_count") > 0, F.col("arg_total") / F.col("read_count")).otherwise(F.lit(0.0))
    return joined.withColumn("arg_total_normalised", per_read)


def missing_metadata(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    return counts.select("sample_id").distinct().join(metadata, "sample_id", "left_anti").agg(F.count("*").alias("n_missing"))


def wide_matrix(counts: DataFrame, args: list[str]) -> DataFrame:
    """One column for each arg of a given (sorted) list, missing as 0."""
    return counts.groupBy(F.col("sample_id")).pivot("arg_id", sorted(args)).agg(F.sum("n")).na.fill(0)


def long_of_wide(matrix: DataFrame, sample: str) -> DataFrame:
    """The long form of a wide matrix, keeping zero cells."""
    args = [c for c in matrix.columns if c != sample]
    return matrix.select(F.col(sample).alias("sample_id"), *args).unpivot("sample_id", args, "arg_id", "n")


def sample_column(columns: list[str], preferred: tuple[str, ...] = ("sample_id", "Sample", "sample", "SampleID")) -> str:
    return next((c for c in preferred if c in columns), columns[0])


def category_counts(df: DataFrame, category: str, target: DataFrame | None = None) -> DataFrame:
    """Rows by category ('NA' for blanks); with targets (category, target) also what is missing to them."""
    counts = df.groupBy(key_or_na(F.col(category)).alias(category)).agg(F.count("*").alias("n"))
    if target is None:
        return counts
    joined = target.join(counts, category, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("shortfall", F.greatest(F.col("target") - F.col("n"), F.lit(0)))


def dataset_checks(counts: DataFrame, metadata: DataFrame, samples: tuple[int, int] = (60, 90), detections: int = 50, environments: int = 2) -> DataFrame:
    """(check, value, result) of the number of samples, detections and environments."""
    c = counts.agg(F.countDistinct("sample_id").alias("samples"), F.count_if(positive(F.col("n").cast("double"))).alias("detections"))
    m = metadata.agg(F.countDistinct(key_or_na(F.col("environment"))).alias("environments"))
    one = c.join(m)  # one row each
    rows = F.array(
        F.struct(F.lit("samples").alias("check"), F.col("samples").alias("value"), pass_fail(F.col("samples").between(*samples)).alias("result")),
        F.struct(F.lit("detections").alias("check"), F.col("detections").alias("value"), pass_fail(F.col("detections") >= detections).alias("result")),
        F.struct(F.lit("environments").alias("check"), F.col("environments").alias("value"), pass_fail(F.col("environments") >= environments).alias("result")),
    )
    return one.select(F.inline(rows))


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float], accuracy: int = 1000) -> DataFrame:
    """(group, n, q): quantiles by linear interpolation between the two values around rank share * (n - 1), from 0.

    A sketch of bounded size gives two values that enclose those ranks (the ends of a group of up to `accuracy` rows); only the
    values between them, some 7 n / accuracy of a larger group, are counted by value and ranked, so no task holds a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    ends = [min(max(p + e * 3.5 / accuracy, 0.0), 1.0) for p in shares for e in (-1, 1)]
    sketch = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, accuracy).alias("e"), F.array(*[f("v") for _ in shares for f in (F.min, F.max)]).alias("m"))
    sketch = sketch.select(F.col("g").alias("__g"), "n", F.when(F.col("n") <= accuracy, F.col("m")).otherwise(F.col("e")).alias("e"))
    near = rows.join(sketch, F.col("g").eqNullSafe(F.col("__g")))
    below = near.groupBy("g", "n").agg(*[F.count_if(F.col("v") < F.col("e")[2 * k]).alias(f"b{k}") for k in range(len(shares))])
    band = F.array_compact(F.array(*[F.when((F.col("v") >= F.col("e")[2 * k]) & (F.col("v") <= F.col("e")[2 * k + 1]), F.lit(k)) for k in range(len(shares))]))
    counted = near.select("g", "v", F.explode(band).alias("k")).groupBy("g", "k", "v").agg(F.count("*").alias("c"))
    offset = below.select(F.col("g").alias("__g"), "n", F.array(*[F.col(f"b{k}") for k in range(len(shares))]).alias("b"))
    placed_ = counted.join(offset, F.col("g").eqNullSafe(F.col("__g"))).withColumn("upto", F.col("b")[F.col("k")] + F.sum("c").over(Window.partitionBy("g", "k").orderBy("v")))
    rank = F.array(*[F.lit(p) for p in shares])[F.col("k")] * (F.col("n") - 1)
    # The value at rank r (from 0) is the first one with more than r values up to it.
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    picked = placed_.withColumn("rank", rank).groupBy("g", "n", "k", "rank").agg(at(F.floor("rank")).alias("lo"), at(F.ceil("rank")).alias("hi"))
    value_ = F.col("lo") + (F.col("rank") - F.floor("rank")) * (F.col("hi") - F.col("lo"))
    whole = picked.groupBy("g", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value_.alias("x")))), lambda s: s["x"]).alias("q"))
    return whole.select(F.col("g").alias(group), "n", "q")


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 interquartile ranges) by group. The rows are written down first: they
    are read three times."""
    rows = cut(df.select(group, value), "box")
    q = exact_quantiles(rows, group, value, [0.25, 0.5, 0.75]).select(F.col(group).alias("__g"), "q")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    v = F.col(value)
    inside = v.between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    agg = rows.join(q, F.col(group).eqNullSafe(F.col("__g"))).groupBy(group, "q").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count("*").alias("n"))
    return agg.select(group, "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in bins of equal width; the last one is closed. Empty bins stay."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("lo")) / step).cast("int"), F.lit(bins - 1))).otherwise(0)
    counted = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))  # ends: one row
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", step.alias("step"))
    return frame.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("lower"), F.coalesce("c", F.lit(0)).alias("n"))


def two_level_sum(df: DataFrame, outer: list[str], inner: str, value: str) -> DataFrame:
    """Means of replicates by (outer, inner), then their sum by outer; what is no number is skipped."""
    means = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*outer, inner).agg(F.avg(value).alias("m"))
    return means.groupBy(*outer).agg(F.sum("m").alias("arg_total"))


def ordered_by_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they come first."""
    return placed(df.groupBy(key).agg(F.min(order).alias("first_seen")), [F.col("first_seen")]).withColumn("place", F.col("place").cast("int"))
