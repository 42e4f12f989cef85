"""Connected components of an identity graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import cut, release


def _ready(df: DataFrame) -> DataFrame:
    return cut(df, "graph")


def identity_edges(pairs: DataFrame, members: DataFrame, threshold: float, a: str = "query_id", b: str = "subject_id", value: str = "pident") -> DataFrame:
    """(a, b) of pairs at or over the threshold with both ends among members (id)."""
    ids = members.select(F.col("id")).distinct()
    kept = pairs.where(F.col(value) >= threshold).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return kept.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def connected(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the ends of edges (a, b) without nulls; root: the least node of the connected component.

    Each round every node with edges points to its least neighbour. This closes only circles of two, whose lesser node
    becomes a root; pointer jumping leads all others to their roots, and edges between roots go on. Every tree has two nodes
    or more, so n nodes take log2(n) rounds at most, of at most log3(n) jumps. keep ends the lineage of what it gets (see scratch.cut); what a round has read is
    removed once the next has been written.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = held = keep(edges.select(F.inline(ways)).distinct())  # edges are worked out once
    label = keep(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    both = both.where("a <> b")
    while both.limit(1).count():
        least = keep(both.groupBy("a").agg(F.min("b").alias("up")))
        next_up = least.select(F.col("a").alias("n"), F.col("up").alias("u"))
        circle = (F.col("u") == F.col("a")) & (F.col("a") < F.col("up"))
        up = least.join(next_up, F.col("up") == F.col("n")).select("a", F.when(circle, F.col("a")).otherwise(F.col("up")).alias("up"))
        walked = None
        while True:  # two steps further each time
            one, two = (up.select(F.col("a").alias(f"n{k}"), F.col("up").alias(f"u{k}")) for k in (1, 2))
            jumped = keep(up.join(one, F.col("up") == F.col("n1")).join(two, F.col("u1") == F.col("n2")).select("a", F.col("up").alias("was"), F.col("u2").alias("up")))
            if walked is not None:
                release(walked)
            walked, up = jumped, jumped.select("a", "up")
            if not jumped.where("up <> was").limit(1).count():
                break
        x, y = up.select(F.col("a").alias("xa"), F.col("up").alias("x")), up.select(F.col("a").alias("ya"), F.col("up").alias("y"))
        onward = keep(both.join(x, F.col("a") == F.col("xa")).join(y, F.col("b") == F.col("ya")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        named = keep(label.join(x, F.col("root") == F.col("xa"), "left").select("node", F.coalesce("x", "root").alias("root")))
        release(held, label, least, walked)
        both = held = onward
        label = named
    least = label.groupBy(F.col("root").alias("r")).agg(F.min("node").alias("least"))
    out = keep(label.join(least, F.col("root") == F.col("r")).select("node", F.col("least").alias("root")))
    release(held, label)
    return out


#: Edges that one task may join: 16 bytes each, and some more for ids of text.
SMALL = 200_000


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of SMALL edges at most, in one task: labels fall to the least neighbour's until none does."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        both = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks])
        names = pc.unique(both)
        names = names.take(pc.sort_indices(names))
        code = pc.index_in(both, names).to_numpy()
        a, b = code[: table.num_rows], code[table.num_rows :]
        label = np.arange(len(names))
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            np.minimum.at(low, label[a], label[b])
            np.minimum.at(low, label[b], label[a])
            low = low[low]
            if (low == label).all():
                break
            label = low
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def clusters(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster_id): the least id that edges (a, b) reach; members without edges are their own cluster.

    Edges with an end that is no member count for nothing. Up to SMALL edges are joined in one task; beyond, each round is written
    down, so that a lost executor costs one.
    """
    ids = members.select("id").distinct()
    inside = edges.where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    inside = _ready(inside.select("a", "b"))
    found = _at_once(inside) if inside.count() <= SMALL else connected(inside, _ready)
    return ids.join(found, ids.id == found.node, "left").select("id", F.coalesce("root", "id").alias("cluster_id"))
