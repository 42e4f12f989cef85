"""Choosing rows: quotas, caps, shared labels, keep-longest, top hits, cluster-pure splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.operators.ranking import placed, running_before, top_of


def first_claim(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order (earlier lists claim a key)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fill_quota(df: DataFrame, group: str, order: list[Column], targets: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The first rows of each group up to its target (group, target). key: columns that tell rows apart (default: all).

    The largest target is read first (one number): it bounds what any task has to sort.
    """
    most = targets.agg(F.max("target")).first()[0] or 0
    ranked = top_of(df.join(targets, group), order, [group], int(most), key or df.columns)
    return ranked.where(F.col("place") <= F.col("target")).drop("target")


def quota_shortfall(taken: DataFrame, group: str, targets: DataFrame) -> DataFrame:
    got = taken.groupBy(group).agg(F.count("*").alias("n"))
    joined = targets.join(got, group, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("missing", F.col("target") - F.col("n")).where("missing > 0")


def cap_per_label(df: DataFrame, label: str, order: list[Column], most: int, n_labels: int | None = None) -> DataFrame:
    """The first max(1, most // labels) rows of each label; without n_labels, the labels of df are counted in the plan."""
    if n_labels is not None:
        return top_of(df, order, [label], max(1, most // n_labels), df.columns)
    n = df.agg(F.countDistinct(label).alias("__n"))
    ranked = top_of(df, order, [label], max(1, most), df.columns).join(F.broadcast(n))  # n: one row
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("__n")))).drop("__n")


def shared_labels(queries: DataFrame, db: DataFrame, label: str, min_query: int, min_db: int) -> DataFrame:
    """Labels frequent enough on both sides, with both counts."""
    q = queries.groupBy(label).agg(F.count("*").alias("n_query")).where(F.col("n_query") >= min_query)
    d = db.groupBy(label).agg(F.count("*").alias("n_db")).where(F.col("n_db") >= min_db)
    return q.join(d, label)


def keep_longest(df: DataFrame, key: list[str], text: str, order: str) -> DataFrame:
    """Of rows with one key, the one of the longest text; the first of ties."""
    others = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(F.length(text), -F.col(order))).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}").alias(c) for c in others])


def head_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def same_source_split(queries: DataFrame, db: DataFrame, label: str, key: str, order: str, most: int, min_db: int) -> tuple[DataFrame, DataFrame]:
    """(chosen queries, remaining db) where queries come from the db's own source.

    By label, queries absent from the db come first; of the others only as many as leave min_db rows in the db.
    """
    present = db.select(F.col(label).alias("__l"), F.col(key).alias("__k")).distinct()
    marked = queries.join(present, (F.col(label) == F.col("__l")) & (F.col(key) == F.col("__k")), "left").withColumn("overlap", F.col("__k").isNotNull()).drop("__l", "__k")
    sizes = db.groupBy(label).agg(F.count("*").alias("__size")).withColumnRenamed(label, "__l")
    absent = marked.groupBy(label).agg(F.count_if(~F.col("overlap")).alias("__absent")).withColumnRenamed(label, "__m")
    # Absent rows come first, so a present row's place among the present ones is its place less their number.
    ranked = top_of(marked, [F.col("overlap"), F.col(order)], [label], most, [key])
    ranked = ranked.join(sizes, F.col(label) == F.col("__l"), "left").join(absent, F.col(label) == F.col("__m"))
    allowed = F.greatest(F.coalesce("__size", F.lit(0)) - min_db, F.lit(0))
    chosen = ranked.where(~F.col("overlap") | (F.col("place") - F.col("__absent") <= allowed)).drop("__l", "__size", "__m", "__absent")
    return chosen, db.join(chosen.select(key).distinct(), key, "left_anti")


def top_hits(hits: DataFrame, query: str, order: list[Column], keep: int = 1) -> DataFrame:
    w = Window.partitionBy(query).orderBy(*order)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def filtered_hits(hits: DataFrame, identity: float = 80, cover: float = 70) -> DataFrame:
    """Hits of enough identity and query cover, the best (bit score, then subject) of each query."""
    good = hits.where((F.col("pident") >= identity) & (F.col("qcov") >= cover))
    return top_hits(good, "qseqid", [F.desc("bitscore"), F.col("sseqid")]).drop("place")


def cluster_split(members: DataFrame, cluster: str, fraction: float) -> DataFrame:
    """members with split: whole clusters, the largest first, go to test until it holds round(n * fraction) members."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("__size"))
    goal = sizes.agg(F.bround(F.sum("__size") * F.lit(fraction)).alias("__goal"))  # one row
    ordered = running_before(sizes, [F.desc("__size"), F.col(cluster)], "__size", "__sum").join(F.broadcast(goal))
    split = ordered.select(cluster, F.when(F.col("__sum") < F.col("__goal"), "test").otherwise("train").alias("split"))
    return members.join(split, cluster)


def split_summary(assigned: DataFrame, cluster: str) -> DataFrame:
    """(metric, value): members in all, in train, in test, and clusters."""
    a = assigned.agg(F.count("*").alias("n_total"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), F.countDistinct(cluster).alias("n_clusters"))
    return a.unpivot([], a.columns, "metric", "value")


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int = 42, draw: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """df with in_test for round(fraction * n) rows of each class, taken by a seeded hash of the key (draw; see coerce.md5_draw)."""
    ranked = placed(df, [draw(F.lit(seed), F.col(key)), F.col(key)], [label], "__place")
    n = df.groupBy(F.col(label).alias("__l")).agg(F.bround(F.count("*") * F.lit(fraction)).alias("__n"))
    return ranked.join(n, F.col(label).eqNullSafe(F.col("__l"))).withColumn("in_test", F.col("__place") <= F.col("__n")).drop("__l", "__n", "__place")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """table with rows put in place of those of the same key, or after them; blank keys go.

    With a numeric column `order` on both sides, replaced rows take the place of the row they replace, and new ones follow in
    their own order, so that sorting by it gives the table as a file would have it.
    """
    named = lambda df: df.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    kept = named(table).join(rows.select(key), key, "left_anti")
    if order is None:
        return kept.unionByName(named(rows))
    old = named(table).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__old"))
    last = table.agg(F.coalesce(F.max(order), F.lit(0)).alias("__last"))  # one row
    first = rows.agg(F.min(order).alias("__first"))  # one row
    put = named(rows).join(old, F.col(key) == F.col("__key"), "left").join(F.broadcast(last)).join(F.broadcast(first))
    place = F.coalesce("__old", F.col("__last") + 1 + F.col(order) - F.col("__first"))
    return kept.unionByName(put.withColumn(order, place.cast(table.schema[order].dataType)).select(*rows.columns))


def merged_longest(first: DataFrame, second: DataFrame, key: list[str], text: str) -> DataFrame:
    """Two record sets put one after the other, then the longest text of each key; of ties the first record of the first set."""
    both = first.withColumn("__set", F.lit(0)).unionByName(second.withColumn("__set", F.lit(1)))
    order = [c for c in first.columns if c == "ord"]
    numbered = both.withColumn("__ord", F.struct("__set", *order))
    others = [c for c in first.columns if c not in key]
    best = numbered.groupBy(*key).agg(F.max(F.length(text)).alias("__n")).withColumnsRenamed({k: f"__{k}" for k in key})
    same = F.length(numbered[text]) == F.col("__n")
    for k in key:
        same = same & numbered[k].eqNullSafe(best[f"__{k}"])
    longest = numbered.join(best, same).groupBy(*key).agg(F.min_by(F.struct(*others), "__ord").alias("x"))
    return longest.select(*key, *[F.col(f"x.{c}").alias(c) for c in others])


def mapped_labels(records: DataFrame, aro_labels: DataFrame, header: Column) -> DataFrame:
    """records with aro and label, by the ARO id of their header; rows without an id, or whose id has no label, go.

    aro_labels (aro, label, ord): the last row of an id counts.
    """
    from fieldbiome.functions.text import aro_id

    known = aro_labels.where("aro is not null and trim(label) <> ''").groupBy(F.col("aro").alias("__aro")).agg(F.max_by("label", "ord").alias("label"))
    found = records.drop("label").withColumn("aro", aro_id(header)).where("aro is not null")
    return found.join(known, F.col("aro") == F.col("__aro")).drop("__aro")
