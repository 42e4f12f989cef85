"""Oversampling of thin bins with seeded, order-free draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import cut
from fieldbiome.functions.settings import Bins
from fieldbiome.operators.ranking import placed


def deficits(rows: DataFrame, bins: Bins, value: str, min_count: int, enforce_upper: float) -> DataFrame:
    """(bin, lower, upper, n, deficit, donor): enforced bins, and the bin that their new rows are drawn from.

    An empty bin draws from the nearest non-empty enforced bin (the lower of ties). The table has one row a bin.
    """
    enforced = [r for r in bins.rows if r[2] <= enforce_upper]
    frame = rows.sparkSession.createDataFrame(enforced, "bin string, lower double, upper double, mid double")
    counts = rows.groupBy(bins.key(F.col(value)).alias("bin")).agg(F.count("*").alias("n"))
    sized = frame.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    donors = sized.where("n > 0").select(F.col("bin").alias("donor"), F.col("mid").alias("dmid"))
    nearest = Window.partitionBy("bin").orderBy(F.abs(F.col("mid") - F.col("dmid")), "dmid")
    picked = sized.join(F.broadcast(donors), F.lit(True)).withColumn("place", F.row_number().over(nearest)).where("place = 1")  # bins x bins
    return picked.select("bin", "lower", "upper", "n", F.greatest(F.lit(min_count) - F.col("n"), F.lit(0)).alias("deficit"), F.when(F.col("n") > 0, F.col("bin")).otherwise(F.col("donor")).alias("donor"))


def oversampled(rows: DataFrame, bins: Bins, value: str, key: str, min_count: int, enforce_upper: float, seed: int = 42, draw: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """rows, then draws with replacement until each enforced bin has min_count; synthetic marks the draws.

    Draw i of a bin takes donor number hash(seed, bin, i) mod donors, donors standing in the order of hash(seed, key); in an empty
    bin its value is uniform within the bin, by hash(seed + 1, bin, i) mod 10^6. draw is the hash (see coerce.md5_draw).
    Rows are written down first: counts, places and the result read them, and what makes them may be long.
    """
    rows = cut(rows, "rows")
    need = deficits(rows, bins, value, min_count, enforce_upper).where("deficit > 0")
    draws = need.select("bin", "lower", "upper", "n", "donor", F.explode(F.sequence(F.lit(1), F.col("deficit").cast("int"))).alias("i"))
    by_bin = rows.withColumn("__bin", bins.key(F.col(value)))
    numbered = placed(by_bin, [draw(F.lit(seed), F.col(key)), F.col(key)], ["__bin"], "__k").withColumn("__k", F.col("__k") - 1)
    sizes = by_bin.groupBy("__bin").agg(F.count("*").alias("__n"))
    aimed = draws.join(sizes, F.col("donor") == F.col("__bin")).drop("__bin").withColumn("__pick", F.pmod(draw(F.lit(seed), F.col("bin"), F.col("i")), F.col("__n")))
    drawn = aimed.join(numbered, (F.col("donor") == F.col("__bin")) & (F.col("__pick") == F.col("__k")))
    u = F.pmod(draw(F.lit(seed + 1), F.col("bin"), F.col("i")), F.lit(1_000_000)) / 1_000_000
    own = F.when(F.col("n") > 0, F.col(value)).otherwise(F.col("lower") + (F.col("upper") - F.col("lower")) * u)
    new = drawn.select(*[own.alias(c) if c == value else F.col(c) for c in rows.columns], F.lit(True).alias("synthetic"))
    return rows.withColumn("synthetic", F.lit(False)).unionByName(new)
