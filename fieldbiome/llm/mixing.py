"""Mixing sources to target weights with hash-threshold histograms; nothing is sorted.

Each document has a hash. A source's target is met by whole passes over it plus one more copy of the documents whose hash is
under a threshold. The threshold is found by summing sizes by (source, hash bucket), walking the cumulated histogram to the
bucket in which the budget ends, and refining only that bucket, level by level. Thresholds of a larger budget contain those
of a smaller one, so mixes are nested.

Defined results: null texts have size 0 (taken 0). A null source is a source of its own, last in order. Rows of one doc_id
share a hash, and so a fate. An empty table gives an empty result. Size 0 sources have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.llm.common import cut, free_name, words_of

#: Bits of the hash that each level of histograms splits by: 3 x 12 bits leave under one document in 10^10 a bucket.
LEVELS = (12, 12, 12)
HASH_BITS = 60


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id's decimal text, which any SQL engine can compute too."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size: one row a source) with the column target.

    target = min(most x source_size, level x weight), with the level at which the targets sum to share x all sizes. That is
    where resharing the excess of capped sources by weight ends. The windows below run over one row a source.
    """
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights)))
    by_ratio = Window.partitionBy().orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    ranked = ranked.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", share * F.sum("source_size").over(all_rows))
        .withColumn("capped", most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # In the order of ratio, the first source that isn't full at the level shared out among it and all after it.
    level = ranked.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    level = level.withColumn("level", F.coalesce(F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(all_rows)["level"], F.lit(float("inf"))))
    return level.select("source", "source_size", F.least(most * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies (times that the mix takes it whole)."""
    base = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), doc_hash(F.col("doc_id")).alias("h"))
    base = cut(base, "sizes")
    size_of = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(size_of, weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = cut(goal.withColumn("passes", full).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    # lo: documents with a hash under it are taken; spent: their size. All sources refine at once, each in one bucket.
    state = goal.select("source", F.lit(0).cast("long").alias("lo"), F.col("rest"), F.lit(0).cast("long").alias("spent"))
    left = HASH_BITS
    for bits in LEVELS:
        width, left = left, left - bits
        inside = base.where("size > 0").join(state, base["source"].eqNullSafe(state["source"])).where(F.shiftright(F.col("h"), width) == F.shiftright(F.col("lo"), width)) if width < HASH_BITS else base.where("size > 0")
        bins = inside.groupBy(base["source"], F.shiftright(F.col("h"), left).alias("bin")).agg(F.sum("size").alias("s"))
        at = bins.join(state.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        run = Window.partitionBy("source").orderBy("bin")
        at = at.withColumn("upto", F.col("spent") + F.sum("s").over(run))
        ends = at.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bin", F.col("upto") - F.col("s")))).alias("end"),
            F.max("bin").alias("last"), F.max("upto").alias("all"), F.first("rest").alias("rest"),
        )
        ends = ends.select(
            "source",
            F.coalesce(F.shiftleft(F.col("end.bin"), left), F.shiftleft(F.col("last") + 1, left)).alias("lo"), "rest",
            F.coalesce(F.col("end.col2"), F.col("all")).alias("spent"),
        )
        state = cut(ends, "thresholds")
    # What still straddles the budget is one bucket of the last level: it goes in if that brings the source nearer its target.
    inside = base.where("size > 0").join(state, base["source"].eqNullSafe(state["source"])).where(F.shiftright(F.col("h"), left) == F.shiftright(F.col("lo"), left))
    edge = inside.groupBy(base["source"]).agg(F.sum("size").alias("edge"))
    state = state.join(edge.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    nearer = F.coalesce(F.col("spent") + F.col("edge") / 2.0 <= F.col("rest"), F.lit(False))
    state = state.select(F.col("source").alias("__s"), F.when(nearer, F.col("lo") + F.shiftleft(F.lit(1).cast("long"), left)).otherwise(F.col("lo")).alias("threshold"))
    known = goal.join(state, F.col("source").eqNullSafe(F.col("__s")), "left").select(F.col("source").alias("__s"), "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    known = cut(known, "mix")
    copies = F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    out = base.join(known, base["source"].eqNullSafe(F.col("__s")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.least(copies, F.lit(int(most)))).otherwise(0).cast("long").alias("copies"))


def take(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix, with the columns of docs: one row for each copy taken.

    Rows of docs with one doc_id get what that id gets (the first of them by size, if they differ).
    """
    d, n = free_name(docs, "__id"), free_name(docs, "__copies")
    chosen = mix(docs, **options).groupBy(F.col("doc_id").alias(d)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    taken = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[d]))
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), chosen[n]))).select(*[docs[c] for c in docs.columns])
