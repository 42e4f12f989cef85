"""Cosine similarity and the predictors that label queries by their nearest database rows.

All pairs are compared, but only what a question needs leaves a pair of blocks: the best row, the k best of each label and their
number, the pairs over a threshold, or links that join what they join. Blocks have BLOCK_BYTES of numbers at most, so a task's
memory doesn't grow with the tables, and are large, so that a row travels to few of them; a pair of blocks is compared by tiles.
Products of floats tell which pairs of a tile may count; only these are summed as doubles, in order. Of equal vectors one is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile: a pair of tiles is a matrix of BLOCK_ROWS x BLOCK_ROWS similarities (32 MB). Tables of fewer rows are one block.
BLOCK_ROWS = 2048
#: Bytes of a block's vectors as doubles, at most, and blocks of a side that are aimed at for the sake of parallel work: up to 786,432
#: vectors of 64 numbers a row travels to 8 blocks, so what is moved grows as the tables do.
BLOCK_BYTES, BLOCKS = 48 << 20, 8
#: The same where all pairs over a threshold leave a pair of blocks.
PAIR_BYTES = 16 << 20
#: Tasks that share the pairs of blocks.
TASKS = 96
#: Pairs that are summed in order at a time.
PAIRS = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, of_zero: float = 0.0) -> Column:
    """of_zero where either vector is zero: 0 as the matrix form has it, or -1 to rank such pairs last."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(of_zero))


def unit_rows(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """The n vectors of a column as rows of length 1; zeros stay."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, 1, size)


Kernel = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table]


def rows_of_block(n: int, dims: int, block_rows: int) -> int:
    """Rows of a block of n vectors of dims numbers: a share of them within BLOCK_BYTES, block_rows at least."""
    return max(block_rows, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(dims, 1))))


def _rows_of_block(block_rows: int, block_bytes: int) -> Column:
    """The same of the rows that are aggregated."""
    dims = F.greatest(F.coalesce(F.max(F.size("v")), F.lit(1)), F.lit(1))
    return F.greatest(F.lit(block_rows), F.least(F.ceil(F.count("*") / BLOCKS), F.floor(F.lit(block_bytes) / (8 * dims))))


def _in_blocks(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, block_rows: int, upper: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """kernel's rows for each pair of a block of left (id, v, ...) and a block of right; upper: left is right, each pair of blocks once.

    The numbers of blocks come from counts within the plan (one row each); 0 block_bytes: blocks have block_rows. Pairs of blocks are
    dealt to a set number of tasks: they hold little, but take long.
    """
    size = _rows_of_block(block_rows, block_bytes)
    sized = lambda df, name: df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(name))
    blocks = F.broadcast(sized(left, "nl").join(sized(right, "nr")))  # one row
    place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    to_last = lambda n, first: F.explode(F.sequence(first, F.col(n) - 1))
    a = left.join(blocks).withColumn("i", place("id", "nl"))
    b = right.join(blocks).withColumn("j", place("id", "nr"))
    a = a.withColumn("j", to_last("nr", F.col("i") if upper else F.lit(0))).drop("nl", "nr")
    if upper:
        b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).drop("nl", "nr")
    else:
        b = b.withColumn("i", to_last("nl", F.lit(0))).drop("nl", "nr")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return kernel(x.slice(0, 0), y.slice(0, 0), np.zeros((0, 1)), np.zeros((0, 1)))
        return kernel(x, y, unit_rows(x.column("v"), x.num_rows), unit_rows(y.column("v"), y.num_rows))

    b = b.withColumnsRenamed({"i": "bi", "j": "bj"})
    a, b = a.repartition(TASKS, "i", "j"), b.repartition(TASKS, "bi", "bj")
    return a.groupBy("i", "j").cogroup(b.groupBy("bi", "bj")).applyInArrow(run, schema)


def vectors(df: DataFrame) -> Column:
    """v, of floats as it is (it is made double where it is compared), all else as doubles."""
    return F.col("v") if dict(df.dtypes)["v"] == "array<float>" else F.col("v").cast("array<double>").alias("v")


def near(dims: int) -> float:
    """What the product of two unit vectors as floats differs from their sum as doubles by, at most."""
    return 1.01 * (dims + 4) * 2.0**-24


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarities of a tile's rows, of floats, within near()."""
    return x @ y.T


def _reaching(sims: np.ndarray, least: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) where sims are least or more, row by row; least is rounded down."""
    return np.divmod(np.flatnonzero(sims >= np.nextafter(np.asarray(least, np.float32), np.float32(-np.inf))), max(sims.shape[1], 1))


def _sums(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Similarities of the rows at of x and to of y, summed in order: equal vectors have equal ones."""
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[at[p : p + PAIRS]], y[to[p : p + PAIRS]]) for p in range(0, len(at), PAIRS)]])


def copies(x: np.ndarray) -> np.ndarray:
    """The first row that equals each row, by its bytes."""
    if not x.size:
        return np.arange(len(x))
    _, first, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first[which.ravel()]


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Rows, in order, of which k at most are equal: the first ones."""
    first = copies(x)
    order = np.argsort(first, kind="stable")
    starts = np.flatnonzero(np.diff(first[order], prepend=-1))
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.sort(order[place < k])


def tops(x: np.ndarray, y: np.ndarray, row_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, best_id, top) of each unit row of x among those of y: the largest similarity, the smallest id that has it, and the k largest."""
    order = np.argsort(row_id, kind="stable")
    y, row_id, few = y[order], row_id[order], min(k, len(y))
    if not few or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return _tops_of_all(x, y, row_id, few)
    one = copies(x)
    asked, back = np.unique(one, return_inverse=True)
    x, kept = x[asked], _first_copies(y, few)
    y, row_id = y[kept], row_id[kept]
    best, best_id, top = np.full(len(x), -np.inf), np.full(len(x), np.iinfo(np.int64).max), np.full((len(x), few), -np.inf)
    x4, y4, off = x.astype(np.float32), y.astype(np.float32), near(x.shape[1])
    for i in range(0, len(x), BLOCK_ROWS):
        rows = slice(i, i + BLOCK_ROWS)
        for j in range(0, len(y), BLOCK_ROWS):
            sims = products(x4[rows], y4[j : j + BLOCK_ROWS])
            n, m = sims.shape
            least = top[rows, -1] - off
            if not j and m > few:  # so many groups of columns have a row of this or more each
                groups = max(few, m // 16)
                most = sims[:, : m // groups * groups].reshape(n, -1, groups).max(1)
                least = np.maximum(least, np.partition(most, groups - few, 1)[:, groups - few] - 2 * off)
            at, to = _reaching(sims, least[:, None])
            if not len(at):
                continue
            counts = np.bincount(at, minlength=n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            here = np.full((n, counts.max()), -np.inf)
            here[at, place] = _sums(x[rows], y[j : j + BLOCK_ROWS], at, to)
            column = np.zeros(here.shape, np.int64)
            column[at, place] = to
            first = here.argmax(1)  # the first of equal ones: the smallest id, as rows go by ids
            of_first = here[np.arange(n), first]
            better = of_first > best[rows]
            best[rows] = np.where(better, of_first, best[rows])
            best_id[rows] = np.where(better, row_id[j + column[np.arange(n), first]], best_id[rows])
            top[rows] = -np.sort(-np.concatenate([top[rows], here], 1), 1)[:, :few]
    return best[back], best_id[back], top[back]


def _tops_of_all(x: np.ndarray, y: np.ndarray, row_id: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with every pair summed in order, for vectors that hold no numbers; rows of y go by ids."""
    n = len(x)
    best, best_id, top = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), np.full((n, few), -np.inf)
    for i in range(0, n, BLOCK_ROWS):
        rows = slice(i, i + BLOCK_ROWS)
        for j in range(0, len(y), BLOCK_ROWS):
            at = slice(j, j + BLOCK_ROWS)
            sims = np.einsum("ij,kj->ik", x[rows], y[at])
            first = sims.argmax(1)  # the first of equal ones: the smallest id, as tiles go by ids
            here = sims[np.arange(len(sims)), first]
            better = (here > best[rows]) | (np.isnan(here) & ~np.isnan(best[rows]))
            best[rows] = np.where(better, here, best[rows])
            best_id[rows] = np.where(better, row_id[at][first], best_id[rows])
            most = sims if sims.shape[1] <= few else np.partition(sims, sims.shape[1] - few, 1)[:, -few:]
            both = np.concatenate([top[rows], most], 1)
            top[rows] = -np.sort(-both, 1)[:, :few]
    return best, best_id, top


def lists(top: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1) * top.shape[1], pa.int32()), pa.array(np.ascontiguousarray(top).ravel()))


def over(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(at, to, sim) of the unit rows of x and y whose similarity is threshold or more, tile by tile."""
    x4, y4, least = x.astype(np.float32), y.astype(np.float32), threshold - near(x.shape[1])
    for i in range(0, len(x), BLOCK_ROWS):
        for j in range(0, len(y), BLOCK_ROWS):
            at, to = _reaching(products(x4[i : i + BLOCK_ROWS], y4[j : j + BLOCK_ROWS]), least)
            sim = _sums(x[i : i + BLOCK_ROWS], y[j : j + BLOCK_ROWS], at, to)
            keep = sim >= threshold
            yield at[keep] + i, to[keep] + j, sim[keep]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that the links a, b reach, but roots: fewer links that join what those do, each node to the least."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        np.minimum.at(low, label[x], label[y])
        np.minimum.at(low, label[y], label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    own = label == np.arange(len(names))
    return names[~own], names[label[~own]]


class _Joined:
    """Nodes by number, and the least that each is joined with."""

    def __init__(self, n: int) -> None:
        self.label, self.most = np.arange(n), 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        apart = a != b
        if apart.any():
            to = np.arange(len(self.label))
            node, root = forest(a[apart], b[apart])
            to[node] = root
            self.label = to[self.label]
            self.most = int(np.bincount(self.label).argmax())


def links(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> pa.Table:
    """(a, b) of links that join what the pairs over the threshold join, fewer than there are rows.

    What is joined already isn't compared: of two tiles, rows outside the largest component meet all, those inside only the rest.
    """
    names, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    joined = _Joined(len(names))
    sides = []
    for side, v in ((code[: len(left)], x), (code[len(left) :], y)):
        order = np.argsort(side, kind="stable")
        side, v = side[order], v[order]
        first, at = copies(v), np.arange(len(v))
        spare = (first != at) & (_sums(v, v, at, at) >= threshold)  # it links what its first copy does, and that one
        joined.join(side[spare], side[first[spare]])
        sides.append((side[~spare], v[~spare], v[~spare].astype(np.float32)))
    (a, x, x4), (b, y, y4) = sides
    least = threshold - near(x.shape[1])
    for i in range(0, len(a), BLOCK_ROWS):
        for j in range(i if same else 0, len(b), BLOCK_ROWS):
            in_a, in_b = (np.flatnonzero(joined.label[c] == joined.most) for c in (a[i : i + BLOCK_ROWS], b[j : j + BLOCK_ROWS]))
            out_a, out_b = (np.setdiff1d(np.arange(n), c, assume_unique=True) for n, c in ((len(a[i : i + BLOCK_ROWS]), in_a), (len(b[j : j + BLOCK_ROWS]), in_b)))
            for p, q in ((out_a, np.arange(len(in_b) + len(out_b))), (in_a, out_b)):
                if not len(p) or not len(q):
                    continue
                at, to = _reaching(products(x4[i + p], y4[j + q]), least)
                at, to = i + p[at], j + q[to]
                for k in range(0, len(at), PAIRS):
                    u, w = at[k : k + PAIRS], to[k : k + PAIRS]
                    apart = joined.label[a[u]] != joined.label[b[w]]
                    u, w = u[apart], w[apart]
                    over_ = _sums(x, y, u, w) >= threshold
                    joined.join(a[u[over_]], b[w[over_]])
    low = np.flatnonzero(joined.label != np.arange(len(names)))
    return pa.table({"a": names[joined.label[low]], "b": names[low]})


def pair_rows(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, same: bool, joined: bool) -> pa.Table:
    """(a, b, sim) with a < b of the rows over the threshold; same: left is right, each pair once. joined: (a, b) of links that join
    the same rows, fewer than there are rows."""
    if joined:
        return links(left, right, x, y, threshold, same) if len(left) and len(right) else pa.table({c: np.zeros(0, np.int64) for c in "ab"})
    held: list[tuple[np.ndarray, ...]] = []
    for at, to, sim in over(x, y, threshold):
        keep = left[at] < right[to] if same else left[at] != right[to]
        held.append((np.minimum(left[at[keep]], right[to[keep]]), np.maximum(left[at[keep]], right[to[keep]]), sim[keep]))
    names = ("a", "b", "sim")
    if not held:
        return pa.table({c: np.zeros(0) if c == "sim" else np.zeros(0, np.int64) for c in names})
    return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*held, strict=True)), strict=True)))


def _sides(queries: DataFrame, db: DataFrame) -> tuple[DataFrame, DataFrame]:
    return queries.select(F.col("query_id").alias("id"), vectors(queries)), db.select(F.col("db_id").alias("id"), "label", vectors(db))


def pair_similarities(queries: DataFrame, db: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, db_id, label, sim) of all query and database rows; queries (query_id, v), db (db_id, label, v).

    All pairs are this operator's result; see class_parts and pairs_over for less.
    """
    q, d = _sides(queries, db)

    def kernel(a: pa.Table, b: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        n, m = a.num_rows, b.num_rows
        at, to = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        sim = np.einsum("ij,kj->ik", x, y).ravel() if n and m else np.zeros(0)
        return pa.table({"query_id": a.column("id").take(pa.array(at)), "db_id": b.column("id").take(pa.array(to)), "label": b.column("label").take(pa.array(to)), "sim": sim})

    label = dict(db.dtypes)["label"]
    return _in_blocks(q, d, kernel, f"query_id long, db_id long, label {label}, sim double", block_rows, block_bytes=0)


def class_parts(queries: DataFrame, db: DataFrame, k: int = 9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each query and label: query_id, label, size, best (similarity), best_id (the smallest of ties), top (the k largest).

    Each pair of blocks gives k numbers a query and label at most; merging them gives those of the whole table.
    """
    q, d = _sides(queries, db)
    label = dict(db.dtypes)["label"]

    def kernel(a: pa.Table, b: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        ids, labels = (a.column("id").to_numpy(), b.column("label").to_pandas()) if a.num_rows else (np.zeros(0, np.int64), pd.Series([], dtype=object))
        names, code = np.unique(labels.to_numpy(), return_inverse=True) if len(labels) else (np.zeros(0), np.zeros(0, np.int64))
        row_id = b.column("id").to_numpy()
        out: list[pa.Table] = []
        for c, name in enumerate(names):
            at = np.flatnonzero(code == c)
            best, best_id, top = tops(x, y[at], row_id[at], k)
            out.append(pa.table({
                "query_id": ids, "label": pa.array([name] * len(ids), b.schema.field("label").type), "size": np.full(len(ids), len(at), np.int64),
                "best": best, "best_id": best_id, "top": lists(top),
            }))
        schema = pa.schema([("query_id", pa.int64()), ("label", b.schema.field("label").type if b.num_columns else pa.int32()), ("size", pa.int64()), ("best", pa.float64()), ("best_id", pa.int64()), ("top", pa.list_(pa.float64()))])
        return pa.concat_tables(out) if out else schema.empty_table()

    found = _in_blocks(q, d, kernel, f"query_id long, label {label}, size long, best double, best_id long, top array<double>", block_rows)
    best = F.max(F.struct("best", (-F.col("best_id")).alias("n")))
    merged = found.groupBy("query_id", "label").agg(F.sum("size").alias("size"), best.alias("x"), F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top"))
    return merged.select("query_id", "label", "size", F.col("x.best").alias("best"), (-F.col("x.n")).alias("best_id"), "top")


def pairs_over(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, joined: bool = False) -> DataFrame:
    """(a, b, sim) with a < b of the rows (id, v) whose cosine is threshold or more; each pair is compared once.

    joined: (a, b) of links that join the same rows instead, of each pair of blocks no more than it has rows.
    """
    side = rows.select("id", vectors(rows))
    other = side.select(F.col("id").alias("other"), F.col("v").alias("w")).toDF("id", "v")  # columns of their own: the table meets itself

    def kernel(a: pa.Table, b: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        own = bool(a.num_rows) and a.column("i")[0].as_py() == a.column("j")[0].as_py()
        return pair_rows(a.column("id").to_numpy(), b.column("id").to_numpy(), x, y, threshold, own, joined)

    return _in_blocks(side, other, kernel, "a long, b long" + ("" if joined else ", sim double"), block_rows, upper=True, block_bytes=BLOCK_BYTES if joined else PAIR_BYTES)


def class_scores(parts: DataFrame, method: str = "class_topk", k: int = 9, penalty: float = 0.03) -> DataFrame:
    """(query_id, label, score) of class_parts by nearest_db, class_max or class_topk; class predictors lose penalty * ln(1 + class size)."""
    score = {"nearest_db": F.col("best"), "class_max": F.col("best") - penalty * F.log1p("size"), "class_topk": class_score_of_top(k, penalty)}
    if method not in score:
        raise ValueError(f"no predictor {method}")
    return parts.select("query_id", "label", score[method].alias("score"))


def centroid_scores(queries: DataFrame, db: DataFrame, penalty: float = 0.03, raw: bool = False) -> DataFrame:
    """(query_id, label, score) by the cosine with each class's mean unit vector, or with the mean of the vectors as they are (raw).
    Classes are few: their centroids are joined."""
    unit = F.col("v").cast("array<double>") if raw else F.when(F.sqrt(dot(F.col("v"), F.col("v"))) > 0, F.transform("v", lambda x: x.cast("double") / F.sqrt(dot(F.col("v"), F.col("v"))))).otherwise(F.col("v").cast("array<double>"))
    cells = db.select("label", F.posexplode(unit).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"), F.count("*").alias("size"))
    centroids = cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"), F.max("size").alias("size"))
    pairs = queries.crossJoin(centroids)  # queries x classes: the result's own size
    return pairs.select("query_id", "label", (cosine(F.col("v"), F.col("c")) - penalty * F.log1p("size")).alias("score"))


def predicted(scores: DataFrame) -> DataFrame:
    """(query_id, pred_label): the label of the largest score, the smallest label of ties."""
    return scores.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("score"), "label")).alias("pred_label"))


def nearest(parts: DataFrame) -> DataFrame:
    """(query_id, db_id, pred_label, sim): the nearest database row of class_parts, the smallest id of ties."""
    best = parts.groupBy("query_id").agg(F.max(F.struct("best", (-F.col("best_id")).alias("n"), "label")).alias("x"))
    return best.select("query_id", (-F.col("x.n")).alias("db_id"), F.col("x.label").alias("pred_label"), F.col("x.best").alias("sim"))


def both_predicted(parts: DataFrame, k: int = 9, penalty: float = 0.03) -> DataFrame:
    """(query_id, db_id, sim, pred_nearest, pred_topk): what nearest and class_topk predict, from one pass over class_parts."""
    scored_ = parts.withColumn("score", class_score_of_top(k, penalty))
    best = scored_.groupBy("query_id").agg(
        F.max(F.struct("best", (-F.col("best_id")).alias("n"), "label")).alias("x"),
        F.min_by("label", F.struct(-F.col("score"), "label")).alias("pred_topk"),
    )
    return best.select("query_id", (-F.col("x.n")).alias("db_id"), F.col("x.best").alias("sim"), F.col("x.label").alias("pred_nearest"), "pred_topk")


def class_score_of_top(k: int, penalty: float) -> Column:
    top = F.slice("top", 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top) - penalty * F.log1p("size")


def scored(predictions: DataFrame, truth: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Predictions with true_label and correct (0/1); extra rows (query_id, ...) join where given."""
    out = predictions.join(truth, "query_id").withColumn("correct", (F.col("pred_label") == F.col("true_label")).cast("int"))
    return out if extra is None else out.join(extra, "query_id")


def embed_with(df: DataFrame, key: str, seq: str, provider: object, max_length: int = 1024, batch: int = 16) -> DataFrame:
    """(key, embedding) by a provider's mean-pooled vectors: provider() gives a function from a list of texts to an array.

    Sequences are cut to max_length residues and spaced, as protein language models read them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                out = model([" ".join(s[:max_length]) for s in part[seq]])
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(np.asarray(out, np.float32))})

    return df.select(key, seq).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def hit_labels(hits: DataFrame, query_labels: DataFrame, db_labels: DataFrame) -> DataFrame:
    """hits (qseqid, sseqid, ...) with true_label and pred_label, where both ids have a label; hits of unknown ids go.

    query_labels (query_id, label) and db_labels (db_id, label) have one row an id (see abundance.last_wins). Which side is
    broadcast is left to the optimizer, by size.
    """
    q = query_labels.select(F.col("query_id").alias("__q"), F.col("label").alias("true_label"))
    d = db_labels.select(F.col("db_id").alias("__d"), F.col("label").alias("pred_label"))
    return hits.join(q, F.col("qseqid") == F.col("__q")).join(d, F.col("sseqid") == F.col("__d")).drop("__q", "__d")
