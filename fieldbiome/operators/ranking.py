"""Places in an order over all rows, or over the rows of each group, without a task that holds a group.

Rows are dealt out by range, so a large group or a table without groups is shared by many tasks; each knows how many rows of its
group the ranges before it hold from a table with one row a range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import cut


def _dealt(df: DataFrame, group: list[str], order: list[Column], range_name: str) -> DataFrame:
    """df with the number of each row's range, written down: ranges must not change between their uses."""
    by = [F.col(g).asc_nulls_first() for g in group] + order
    return cut(df.repartitionByRange(*by).withColumn(range_name, F.spark_partition_id()), "ranges")


def _before(dealt: DataFrame, group: list[str], range_name: str, amount: Column, name: str) -> DataFrame:
    """(range, group, name): the sum of amount over the rows of the group in the ranges before."""
    sums = dealt.groupBy(range_name, *group).agg(amount.alias("__s"))
    earlier = Window.partitionBy(*group).orderBy(range_name).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(range_name, *group, F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias(name))


def _joined(dealt: DataFrame, before: DataFrame, group: list[str], range_name: str, name: str) -> DataFrame:
    renamed = before.select(F.col(range_name).alias("__pr"), *[F.col(g).alias(f"__pg{k}") for k, g in enumerate(group)], name)
    on = dealt[range_name] == renamed["__pr"]
    for k, g in enumerate(group):
        on = on & dealt[g].eqNullSafe(renamed[f"__pg{k}"])
    return dealt.join(renamed, on).drop("__pr", *[f"__pg{k}" for k in range(len(group))])


def placed(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with each row's place from 1 in the order, within its group if there is one. Ties of the whole order stand in any order."""
    group = group or []
    dealt = _dealt(df, group, order, "__range")
    out = _joined(dealt, _before(dealt, group, "__range", F.count("*"), "__before"), group, "__range", "__before")
    here = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order))
    return out.withColumn(name, F.col("__before") + here).drop("__range", "__before")


def running_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows that stand before each one in the order."""
    dealt = _dealt(df, [], order, "__range")
    out = _joined(dealt, _before(dealt, [], "__range", F.sum(value), "__before"), [], "__range", "__before")
    earlier = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop("__range", "__before")


def top_of(df: DataFrame, order: list[Column], group: list[str], most: int, key: list[str], name: str = "place", shares: int = 64) -> DataFrame:
    """The first `most` rows of each group, with their place. A group is first cut down in shares, by a hash of the key columns, so
    that no task sorts a whole group: shares x most rows of it at most are left for the second look."""
    dealt = df.withColumn("__share", F.pmod(F.xxhash64(*key), F.lit(shares)))
    first = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*group, "__share").orderBy(*order))).where(F.col(name) <= most)
    return first.drop("__share").withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)
